"""Added mass of potential flow about a body of revolution, as matrix entries for each harmonic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fluid
from . import detect, mesh


def meridional_profile(wet: DataFrame, nodes: DataFrame, digits: int = 10) -> np.ndarray:
    """The outline (r, z) of wetted faces (about z), point after point.

    Corners with equal (r, z) are one point. Edges of one face alone, in that projection, are
    chained; where there are none, points go around their centre. The outline is turned to run
    clockwise, so that left normals point into the fluid. It has a few hundred points, which
    the driver holds.
    """
    on = wet.select(F.explode("nodes").alias("node_id")).distinct()
    radius = F.hypot("x", "y")
    placed = nodes.join(on, "node_id", "left_semi").select("node_id", F.round(radius, digits).alias("r"), F.round("z", digits).alias("z"))
    merged = placed.groupBy("r", "z").agg(F.min("node_id").alias("point_id"))
    name = placed.join(merged, ["r", "z"]).select("node_id", "point_id")
    n = F.col("nodes")
    sides = F.array(*[F.struct(n[i].alias("p"), n[j].alias("q")) for i, j in ((0, 1), (1, 2), (2, 0))])
    edges = wet.select(F.explode(sides).alias("e")).select("e.p", "e.q")
    for end, to in (("p", "u"), ("q", "v")):
        edges = edges.join(name.select(F.col("node_id").alias(end), F.col("point_id").alias(to)), end)
    once = edges.where("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n")).where("n = 1")
    order = detect.chain(once)
    at = {r["point_id"]: (r["r"], r["z"]) for r in merged.collect()}
    if not order:
        order = [r["point_id"] for r in detect.around_centre(merged).orderBy("place").collect()]
    out = np.array([at[p] for p in order], float).reshape(-1, 2)
    r, z = out.T
    return out[::-1] if np.sum(r * np.roll(z, -1) - np.roll(r, -1) * z) > 0 else out


def outline_panels(profile: np.ndarray) -> dict[str, np.ndarray]:
    """P29 for an outline on the driver: middles, lengths and left normals."""
    step = np.diff(profile, axis=0)
    size = np.linalg.norm(step, axis=1)
    safe = np.where(size > 0, size, 1.0)
    return {"r_mid": (profile[1:, 0] + profile[:-1, 0]) / 2, "z_mid": (profile[1:, 1] + profile[:-1, 1]) / 2, "nr": -step[:, 1] / safe, "nz": step[:, 0] / safe, "len": size}


def added_mass_entries(wet: DataFrame, nodes: DataFrame, density: float, sectors: int, harmonics: list[int]) -> DataFrame:
    """(k, row, col, val) of a sector's added mass at each harmonic.

    Each panel of the outline moves with the wetted node nearest to its middle (ties by id),
    along its normal; panels couple by the potential of ring sources. One task a harmonic.
    Panels must not be longer than the walls between them are thick: beyond that the panel
    method gives masses that aren't positive, and the solve a row with that status.
    """
    spark, profile = nodes.sparkSession, meridional_profile(wet, nodes)
    schema = "k int, row int, col int, val double"
    if len(profile) < 2:
        return spark.createDataFrame([], schema)
    panels = {name: v[outline_panels(profile)["len"] > 0] for name, v in outline_panels(profile).items()}
    points = spark.createDataFrame([(i, float(r), float(z)) for i, (r, z) in enumerate(zip(panels["r_mid"], panels["z_mid"], strict=True))], "point_id int, r double, z double")
    on = nodes.join(wet.select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_semi")
    near = mesh.nearest_panel(points, on.select(F.col("node_id").alias("panel_id"), F.hypot("x", "y").alias("r_mid"), F.col("z").alias("z_mid")))
    held = near.join(on, near["panel_id"] == on["node_id"]).select("point_id", "node_id", "x", "y").orderBy("point_id").toPandas()
    r = np.hypot(held["x"], held["y"]).to_numpy()
    cos, sin = (np.where(r > 1e-15, held[c] / np.maximum(r, 1e-15), one) for c, one in (("x", 1.0), ("y", 0.0)))
    dofs = np.unique(3 * held["node_id"].to_numpy()[:, None] + np.arange(3))
    project = np.zeros((len(held), len(dofs)))
    for d, v in enumerate((panels["nr"] * cos, panels["nr"] * sin, panels["nz"])):
        project[np.arange(len(held)), np.searchsorted(dofs, 3 * held["node_id"].to_numpy() + d)] = v

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for k in rows["k"]:
                m = project.T @ fluid.added_mass(int(k), panels, density) @ project / sectors
                i, j = np.nonzero(np.abs(m) > 1e-20)
                yield pd.DataFrame({"k": k, "row": dofs[i], "col": dofs[j], "val": m[i, j]})

    wanted = spark.createDataFrame([(k,) for k in harmonics], "k int")
    return wanted.repartition(max(1, len(harmonics)), "k").mapInPandas(run, schema)
