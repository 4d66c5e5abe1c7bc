"""Sector boundaries from geometry: nodes, surfaces and the meridional outline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from . import mesh


def named_boundaries(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """left, right and free nodes by their sets; the first two must be there."""
    have = {r["set_name"] for r in sets.where(F.col("set_name").isin("left_boundary", "right_boundary")).select("set_name").distinct().collect()}
    for name in ("left_boundary", "right_boundary"):
        if name not in have:
            raise ValueError(f"the mesh has no set {name}")
    return tuple(sets.where(F.col("set_name") == n).select("node_id").distinct() for n in ("left_boundary", "right_boundary", "free_boundary"))


def mean_edge(elements: DataFrame, nodes: DataFrame, first: int = 100) -> DataFrame:
    """One row: the mean length of the corner edges of the ``first`` elements by id (as the tolerance's rule has it)."""
    pairs = F.array(*[F.struct(F.col("conn")[i].alias("p"), F.col("conn")[j].alias("q")) for i in range(4) for j in range(i)])
    edges = elements.orderBy("elem_id").limit(first).select(F.explode(pairs).alias("e")).select("e.p", "e.q")
    side = lambda s: nodes.select(F.col("node_id").alias(s), *[F.col(c).alias(f"{s}{c}") for c in "xyz"])
    size = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0)))
    return edges.join(side("p"), "p").join(side("q"), "q").agg(F.avg(size).alias("mean_edge"))


#: Fixed value: a mesh's tolerance is 0.3 edges, so that a cell holds a few surface nodes.
CELL = 4


def _cell(c: str, tolerance: float, by: float = 0.0) -> Column:
    return F.floor((F.col(c) + by) / (CELL * tolerance))


def turned_cells(surface: DataFrame, sectors: int, tolerance: float) -> DataFrame:
    """Nodes turned by one sector (left_id, tx, ty, tz), a row for each cell (cx, cy, cz) that is within the tolerance.

    A cell is CELL tolerances wide, so that few nodes lie as near to a side that they look over it.
    """
    a = 2 * math.pi / sectors
    wide = 1.001 * tolerance  # sums are rounded
    turned = surface.select(F.col("node_id").alias("left_id"), (F.col("x") * math.cos(a) - F.col("y") * math.sin(a)).alias("tx"), (F.col("x") * math.sin(a) + F.col("y") * math.cos(a)).alias("ty"), F.col("z").alias("tz"))
    for c in "xyz":
        turned = turned.withColumn(f"c{c}", F.explode(F.array_distinct(F.array(_cell(f"t{c}", tolerance, -wide), _cell(f"t{c}", tolerance, wide)))))
    return turned


def sector_sides(surface: DataFrame, sectors: int, tolerance: float) -> DataFrame:
    """Pairs (left_id, right_id, distance) of surface nodes that a turn by one sector about z brings together.

    A turned node takes its nearest surface node within the tolerance, whose radius and height
    must differ by no more, either; of several turned nodes the one with the smallest id gets
    it. Nodes meet in cells, so that the join is on equal keys. It is a merge join whatever
    sizes Catalyst expects: a file of ids may be far smaller than the places made from them,
    and a broadcast of those would pass through the driver.
    """
    own = surface.select(F.col("node_id").alias("right_id"), "x", "y", "z", *[_cell(c, tolerance).alias(f"c{c}") for c in "xyz"])
    distance = F.sqrt(sum(((F.col(f"t{c}") - F.col(c)) * (F.col(f"t{c}") - F.col(c)) for c in "xyz"), F.lit(0.0)))
    found = turned_cells(surface, sectors, tolerance).join(own.hint("merge"), ["cx", "cy", "cz"]).withColumn("distance", distance).where(F.col("distance") <= tolerance)
    nearest = found.groupBy("left_id").agg(F.min(F.struct("distance", "right_id", (F.abs(F.hypot("tx", "ty") - F.hypot("x", "y"))).alias("dr"), F.abs(F.col("tz") - F.col("z")).alias("dz"))).alias("n"))
    fits = nearest.where((F.col("n.dr") <= tolerance) & (F.col("n.dz") <= tolerance)).select("left_id", "n.right_id", "n.distance")
    return fits.withColumn("r", F.row_number().over(Window.partitionBy("right_id").orderBy("left_id"))).where("r = 1").drop("r")


def snapped(nodes: DataFrame, pairs: DataFrame, sectors: int) -> DataFrame:
    """Right nodes moved to exactly where their left ones turn to."""
    a = 2 * math.pi / sectors
    left = nodes.select(F.col("node_id").alias("left_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("z").alias("lz"))
    to = pairs.join(left, "left_id").select(F.col("right_id").alias("node_id"), (F.col("lx") * math.cos(a) - F.col("ly") * math.sin(a)).alias("nx"), (F.col("lx") * math.sin(a) + F.col("ly") * math.cos(a)).alias("ny"), F.col("lz").alias("nz"))
    return nodes.join(to, "node_id", "left").select("node_id", *[F.coalesce(f"n{c}", c).alias(c) for c in "xyz"])


def detected_sets(elements: DataFrame, nodes: DataFrame, sectors: int, hub_share: float = 0.15, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapped nodes, sets left, right, hub and free) of a sector mesh without named boundaries."""
    faces = mesh.with_normals(mesh.boundary_faces(elements), nodes)
    on = faces.select(F.explode("nodes").alias("node_id")).distinct()
    tolerance = tolerance or 0.3 * mean_edge(elements, nodes).first()[0]
    pairs = mesh.checkpointed(sector_sides(nodes.join(on, "node_id", "left_semi"), sectors, tolerance))
    if pairs.isEmpty():
        raise ValueError("no surface nodes meet after a turn by one sector")
    left, right = pairs.select(F.col("left_id").alias("node_id")), pairs.select(F.col("right_id").alias("node_id"))
    placed = snapped(nodes, pairs, sectors)
    hub = mesh.hub_nodes(faces, placed, left.unionByName(right), hub_share)
    free = mesh.free_boundary(on, left, right, hub)
    named = [df.select(F.lit(n).alias("set_name"), "node_id") for n, df in (("left_boundary", left), ("right_boundary", right), ("hub_constraint", hub), ("free_boundary", free))]
    return placed, named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


def surface_pairs(left: DataFrame, right: DataFrame, sectors: int, most: float) -> DataFrame:
    """Left surfaces (surface_id, x, y, z of the centre) with right ones nearest after a turn
    about z, each once, within ``most``. Nearest pairs go first."""
    swapped = mesh.match_within(left.withColumnRenamed("surface_id", "node_id"), right.withColumnRenamed("surface_id", "node_id"), sectors, F.lit(most))
    return swapped.select(F.col("left_id").alias("left_surface"), F.col("right_id").alias("right_surface"), "distance")


def surface_sides(surface_nodes: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The side that more than half of a surface's nodes (surface_id, node_id) are on, if any; left first."""
    flag = lambda df, n: df.select("node_id", F.lit(1.0).alias(n)).distinct()
    rows = surface_nodes.distinct().join(flag(left, "l"), "node_id", "left").join(flag(right, "r"), "node_id", "left")
    share = rows.groupBy("surface_id").agg(F.avg(F.coalesce("l", F.lit(0.0))).alias("l"), F.avg(F.coalesce("r", F.lit(0.0))).alias("r"))
    return share.select("surface_id", F.when(F.col("l") > 0.5, "left").when(F.col("r") > 0.5, "right").alias("side")).where("side is not null")


def wedge_surfaces(surfaces: DataFrame, samples: DataFrame, sectors: int) -> DataFrame:
    """surfaces (surface_id, centre x y z, normal nx ny nz) that can bound a sector about z:
    not facing along the axis, facing along the circumference, and with edge points (surface_id,
    theta) that spread over a tenth of a sector at most, from the 10th to the 90th percentile."""
    r = F.hypot("x", "y")
    across = F.abs((F.col("ny") * F.col("x") - F.col("nx") * F.col("y")) / r)
    facing = surfaces.where((F.abs("nz") <= 0.5) & (r >= 1e-10)).where(across > 0.5)
    turn = F.pmod(F.col("theta") - F.atan2("y", "x") + math.pi, F.lit(physics.TWO_PI)) - math.pi
    spread = samples.join(facing.select("surface_id", "x", "y"), "surface_id").withColumn("d", turn).groupBy("surface_id").agg(F.count("*").alias("n"), (F.percentile("d", F.lit(0.9)) - F.percentile("d", F.lit(0.1))).alias("spread"))
    wide = spread.where((F.col("n") >= 4) & (F.col("spread") > 0.1 * physics.TWO_PI / sectors)).select("surface_id")
    return facing.join(wide, "surface_id", "left_anti")


def box_summary(boxes: DataFrame) -> DataFrame:
    """Over bounding boxes (x0, x1, y0, y1, z0, z1) of entities: the whole box, radii over the
    boxes' corners about z, axial length, and a mesh size of a twentieth of the largest extent."""
    corner = F.array(*[F.hypot(x, y) for x in ("x0", "x1") for y in ("y0", "y1")])
    whole = [f(f"{c}{i}").alias(f"{n}_{c}") for c in "xyz" for i, f, n in ((0, F.min, "min"), (1, F.max, "max"))]
    out = boxes.agg(*whole, F.min(F.array_min(corner)).alias("inner_r"), F.max(F.array_max(corner)).alias("outer_r"))
    size = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")
    return out.withColumn("axial_length", size("z")).withColumn("mesh_size", F.greatest(*[size(c) for c in "xyz"]) / 20)


def chain(edges: DataFrame) -> list[int]:
    """Points along the meridional outline (a, b): from the first end point, or else the first
    point, on to the first neighbour not yet visited. One outline is a few hundred points."""
    near: dict[int, list[int]] = {}
    for a, b in sorted((r["a"], r["b"]) for r in edges.select("a", "b").distinct().collect()):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    if not near:
        return []
    at: int | None = next((n for n in sorted(near) if len(near[n]) == 1), min(near))
    out: list[int] = []
    seen: set[int] = set()
    while at is not None:
        out.append(at)
        seen.add(at)
        at = next((n for n in near[at] if n not in seen), None)
    return out


def around_centre(points: DataFrame, centred: bool = False) -> DataFrame:
    """T7 without edges: points (point_id, r, z) ranked by their angle about their centre, or about 0 if ``centred``."""
    mean = points.agg(F.avg("r").alias("mr"), F.avg("z").alias("mz")).select(*[F.when(F.lit(centred), 0.0).otherwise(F.col(c)).alias(c) for c in ("mr", "mz")])
    angle: Column = F.atan2(F.col("z") - F.col("mz"), F.col("r") - F.col("mr"))
    turned = points.crossJoin(F.broadcast(mean)).withColumn("angle", angle)
    return turned.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("angle", "point_id"))).select("point_id", "r", "z", "place")
