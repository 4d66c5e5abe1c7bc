"""Assembly and cyclic projection as DataFrames; element and eigen kernels as grouped maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..kernels import eigen, element
from . import fluid, mesh, sparse


def gathered(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each element with its ids and its 30 coordinates, in local order."""
    rows = elements.select("elem_id", F.posexplode("conn").alias("local", "node_id")).join(nodes, "node_id")
    ordered = F.array_sort(F.collect_list(F.struct("local", "node_id", "x", "y", "z")))
    return rows.groupBy("elem_id").agg(ordered.alias("n")).select("elem_id", F.transform("n", lambda r: r["node_id"]).alias("ids"), F.flatten(F.transform("n", lambda r: F.array(r["x"], r["y"], r["z"]))).alias("xyz"))


def triplets(elements: DataFrame, nodes: DataFrame, e: float, nu: float, rho: float, axis: str = "z") -> DataFrame:
    """Unassembled entries (mat, row, col, val) of K, M, K_omega and G, and F as column 0.

    A partition's elements go through numpy together; tiny entries are dropped (F10).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for at in range(0, len(rows), 256):
                part = rows.iloc[at : at + 256]
                x = np.stack(part["xyz"].to_list()).reshape(-1, 10, 3)
                ids = np.stack(part["ids"].to_list())
                for name, m in element.matrices(x, e, nu, rho, axis).items():
                    if name == "F":
                        yield pd.DataFrame({"mat": name, "row": (3 * ids[:, :, None] + np.arange(3)).ravel(), "col": 0, "val": m.ravel()})
                    else:
                        yield from _entries(name, m, ids)

    return gathered(elements, nodes).mapInPandas(run, "mat string, row int, col int, val double")


def assembled(elements: DataFrame, nodes: DataFrame, e: float, nu: float, rho: float, axis: str = "z") -> DataFrame:
    """A1, A2: the global matrices, told apart by ``mat``."""
    return sparse.assemble(triplets(elements, nodes, e, nu, rho, axis), ("mat", "row", "col"))


def mass_of(assembled_rows: DataFrame) -> DataFrame:
    """Total mass: a third of the sum of M's entries between equal directions."""
    return assembled_rows.where("mat = 'M' and row % 3 = col % 3").agg((F.sum("val") / 3).alias("mass"))


def turned_dofs(pairs: DataFrame, sectors: int, axis: str = "z") -> DataFrame:
    """``dof, to, t``: a right degree of freedom as the left ones turned by a sector about ``axis``."""
    a = physics.TWO_PI / sectors
    i, j, k = {"z": (0, 1, 2), "x": (1, 2, 0), "y": (2, 0, 1)}[axis]
    turn = [(i, i, np.cos(a)), (i, j, -np.sin(a)), (j, i, np.sin(a)), (j, j, np.cos(a)), (k, k, 1.0)]
    entries = F.array(*[F.struct(F.lit(p).alias("i"), F.lit(q).alias("j"), F.lit(float(v)).alias("v")) for p, q, v in turn])
    return pairs.select("left_id", "right_id", F.explode(entries).alias("e")).select((3 * F.col("right_id") + F.col("e.i")).alias("dof"), (3 * F.col("left_id") + F.col("e.j")).alias("to"), F.col("e.v").alias("t"))


def cyclic_terms(matrix: DataFrame, pairs: DataFrame, sectors: int, axis: str = "z") -> DataFrame:
    """Entries (mat, part, row, col, val) with right nodes expressed by their left ones.

    A right degree of freedom is the phase times the left one turned by a sector. Part 0 has
    no phase, +1 has P and -1 its conjugate, so that any harmonic is a sum over parts. The
    load (mat F, column 0) is no matrix: see :func:`cyclic_load`.
    """
    t = turned_dofs(pairs, sectors, axis)
    own = lambda x: F.coalesce(F.col(f"{x}_t"), F.lit(1.0))
    side = lambda x: t.select(F.col("dof").alias(x), F.col("to").alias(f"{x}_to"), F.col("t").alias(f"{x}_t"))
    joined = matrix.where("mat <> 'F'").join(side("row"), "row", "left").join(side("col"), "col", "left")
    part = F.when(F.col("col_t").isNotNull(), 1).otherwise(0) - F.when(F.col("row_t").isNotNull(), 1).otherwise(0)
    out = joined.select("mat", part.alias("part"), F.coalesce("row_to", "row").alias("row"), F.coalesce("col_to", "col").alias("col"), (F.col("val") * own("row") * own("col")).alias("val"))
    return sparse.assemble(out, ("mat", "part", "row", "col"))


def cyclic_load(matrix: DataFrame, pairs: DataFrame, sectors: int, axis: str = "z") -> DataFrame:
    """The load (row, val) at harmonic 0: what acts on right nodes is turned back onto their left ones."""
    t = turned_dofs(pairs, sectors, axis).select(F.col("dof").alias("row"), "to", "t")
    out = matrix.where("mat = 'F'").select("row", "val").join(t, "row", "left")
    return out.select(F.coalesce("to", "row").alias("row"), (F.col("val") * F.coalesce("t", F.lit(1.0))).alias("val")).groupBy("row").agg(F.sum("val").alias("val"))


#: Entries of a sector's terms at most: every task of a solve holds them, and a dense matrix beside them.
MOST_TERMS = 20_000_000


def solve(terms: DataFrame, fixed: DataFrame, conditions: DataFrame, sectors: int, modes: int, centrifugal: bool = True, harmonics: list[int] | None = None, floor_hz: float = 0.0, coriolis: bool = False, ratios: dict[int, float] | None = None) -> DataFrame:
    """Modes of every condition (cond_id, rpm) and harmonic, as one task each.

    ``terms`` come from :func:`cyclic_terms`, by ``mat``: K and M; K_omega softens and K_sigma
    (see :func:`prestress`) stiffens with the square of the speed; K_spring adds to K as it is;
    G is the gyroscopic matrix; what is called A and a harmonic adds to that harmonic's mass.
    ``fixed`` has the column dof. A condition's column
    ``modulus``, if there is one, scales K (P2: a modulus at its temperature over that of the
    terms). ``ratios`` (P13) scale the frequencies of their harmonics, where they lie between
    0 and 1. Rows: cond_id, rpm, k, mode_idx, freq_hz, whirl, residual, shape_re, shape_im (by
    ``dofs``). Harmonics that fail give one row with a status instead of nothing (Q12).
    """
    ks = [k for k in (harmonics or range(sectors // 2 + 1)) if 0 <= k <= sectors // 2]
    spark = terms.sparkSession
    free = terms.join(fixed.select(F.col("dof").alias("row")), "row", "left_anti").join(fixed.select(F.col("dof").alias("col")), "col", "left_anti")
    shared = spark.sparkContext.broadcast(_packed(free))
    scale = F.col("modulus") if "modulus" in conditions.columns else F.lit(1.0)
    grid = conditions.select("cond_id", "rpm", scale.cast("double").alias("modulus"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    names = "cond_id int, rpm double, k int, mode_idx int, freq_hz double, whirl int, residual double, dofs array<int>, shape_re array<double>, shape_im array<double>, status string"

    columns = [c.split()[0] for c in names.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for cond, rpm, modulus, k in rows.itertuples(index=False):
                try:
                    out = _solve_one(rpm, k, modulus, shared.value, sectors, modes, centrifugal, floor_hz, coriolis)
                    if 0 < (ratio := (ratios or {}).get(k, 1.0)) < 1:
                        out["freq_hz"] *= ratio
                except np.linalg.LinAlgError as error:
                    out = pd.DataFrame({c: [None] for c in columns}, dtype=object).assign(status=str(error))
                yield out.assign(cond_id=cond, rpm=rpm, k=k)[columns]

    tasks = max(1, spark.sparkContext.defaultParallelism)
    return grid.repartition(tasks, "cond_id", "rpm", "k").mapInPandas(run, names)


def _packed(free: DataFrame) -> dict[str, np.ndarray]:
    """The terms of a sector as arrays."""
    n = free.count()
    if n > MOST_TERMS:
        raise ValueError(f"{n} entries are more than a task can solve; condense the sector first")
    found = free.select("mat", "part", "row", "col", "val").toArrow()
    return {name: found.column(name).to_numpy() for name in ("part", "row", "col", "val")} | {"mat": np.array(found.column("mat").to_pylist(), object)}


def _solve_one(rpm, k, modulus, terms, sectors, modes, centrifugal, floor_hz, coriolis) -> pd.DataFrame:
    dofs = np.unique(terms["row"])
    r, c = np.searchsorted(dofs, terms["row"]), np.searchsorted(dofs, terms["col"])
    phase = np.exp(1j * k * physics.TWO_PI / sectors * terms["part"])
    omega = rpm * physics.TWO_PI / 60

    def matrix(name: str) -> np.ndarray:
        own = terms["mat"] == name
        out = np.zeros((len(dofs), len(dofs)), complex)
        np.add.at(out, (r[own], c[own]), terms["val"][own] * phase[own])
        return out

    stiff, mass = modulus * matrix("K") + matrix("K_spring"), matrix("M") + matrix(f"A{k}")
    if centrifugal and omega:
        stiff = stiff + omega**2 * (matrix("K_sigma") - matrix("K_omega"))
    twice = 0 < k and 2 * k != sectors
    if coriolis and omega and k > 0:
        freq, whirl, x = eigen.quadratic(stiff, 2j * omega * matrix("G"), mass, modes)
        residual = np.full(len(freq), np.nan)
    else:
        if not twice:
            stiff, mass = stiff.real, mass.real
        n = -(-modes // 2) if twice else modes
        values, x, residual = eigen.hermitian(stiff, mass, min(len(dofs), n + 6))
        freq = np.sqrt(np.maximum(values, 0)) / physics.TWO_PI
        keep = np.flatnonzero(freq > floor_hz)[:n]
        if twice:  # U2: both directions of travel, the second as the conjugate
            keep, whirl = np.repeat(keep, 2)[:modes], np.tile([1, -1], len(keep))[:modes]
            x = np.where(whirl < 0, x[:, keep].conj(), x[:, keep])
        else:
            whirl, x = np.zeros(len(keep), int), x[:, keep]
        freq, residual = freq[keep], residual[keep]
    n = len(freq)
    return pd.DataFrame({
        "mode_idx": np.arange(n), "freq_hz": freq, "whirl": whirl, "residual": residual, "dofs": [dofs] * n,
        "shape_re": [np.ascontiguousarray(v.real) for v in x.T], "shape_im": [np.ascontiguousarray(v.imag) for v in x.T], "status": "solved",
    })


def static_unit(terms: DataFrame, load: DataFrame, fixed: DataFrame) -> DataFrame:
    """L4: displacements (dof, u) at harmonic 0 under the centrifugal load (row, val) of unit speed."""
    free = lambda df, side: df.join(fixed.select(F.col("dof").alias(side)), side, "left_anti")
    k = free(free(terms.where("mat in ('K', 'K_spring')"), "row"), "col")
    spark = terms.sparkSession
    shared = spark.sparkContext.broadcast((_packed(k), free(load.select("row", "val"), "row").toArrow()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in parts:
            k, f = shared.value
            dofs = np.unique(k["row"])
            a, b = np.zeros((len(dofs), len(dofs))), np.zeros(len(dofs))
            np.add.at(a, (np.searchsorted(dofs, k["row"]), np.searchsorted(dofs, k["col"])), k["val"])
            row, val = f.column("row").to_numpy(), f.column("val").to_numpy()
            own = np.isin(row, dofs)
            np.add.at(b, np.searchsorted(dofs, row[own]), val[own])
            yield pd.DataFrame({"dof": dofs, "u": np.linalg.solve(a, b)})

    return spark.range(1, numPartitions=1).mapInPandas(run, "dof int, u double")


def static_solve(terms: DataFrame, load: DataFrame, fixed: DataFrame, rpms: DataFrame) -> DataFrame:
    """L4: displacements (rpm, dof, u). The load grows with the square of the speed, so that one
    solve at unit speed serves all speeds."""
    speed = F.pow(physics.angular(F.col("rpm")), 2)
    return static_unit(terms, load, fixed).crossJoin(rpms).select("rpm", "dof", (F.col("u") * speed).alias("u"))


def full_displacement(u: DataFrame, pairs: DataFrame, nodes: DataFrame, sectors: int, axis: str = "z") -> DataFrame:
    """Displacements (node_id, ux, uy, uz) of all nodes from those of the reduced set: right nodes
    turn with their left ones, fixed ones stay at zero."""
    right = turned_dofs(pairs, sectors, axis).join(u.select(F.col("dof").alias("to"), "u"), "to").groupBy("dof").agg(F.sum(F.col("t") * F.col("u")).alias("u"))
    every = u.join(right.select("dof"), "dof", "left_anti").unionByName(right)
    placed = every.groupBy(F.floor(F.col("dof") / 3).alias("node_id")).agg(*[F.max(F.when(F.col("dof") % 3 == d, F.col("u"))).alias(f"u{c}") for d, c in enumerate("xyz")])
    return nodes.select("node_id").join(placed, "node_id", "left").select("node_id", *[F.coalesce(f"u{c}", F.lit(0.0)).alias(f"u{c}") for c in "xyz"])


def prestress(elements: DataFrame, nodes: DataFrame, displacement: DataFrame, e: float, nu: float) -> DataFrame:
    """Assembled K_sigma of the stress that a displacement (node_id, ux, uy, uz) causes.

    With the displacement of unit speed it is K_sigma over the square of the speed, and free of
    the modulus, which the displacement divides by.
    """
    rows = elements.select("elem_id", F.posexplode("conn").alias("local", "node_id")).join(nodes, "node_id").join(displacement, "node_id")
    ordered = F.array_sort(F.collect_list(F.struct("local", "node_id", "x", "y", "z", "ux", "uy", "uz")))
    flat = lambda names: F.flatten(F.transform("n", lambda r: F.array(*[r[c] for c in names])))
    gathered_rows = rows.groupBy("elem_id").agg(ordered.alias("n")).select(F.transform("n", lambda r: r["node_id"]).alias("ids"), flat(["x", "y", "z"]).alias("xyz"), flat(["ux", "uy", "uz"]).alias("u"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                m = element.stress_stiffness(np.stack(part["xyz"].to_list()).reshape(-1, 10, 3), np.stack(part["u"].to_list()).reshape(-1, 30), e, nu)
                yield from _entries("K_sigma", m, np.stack(part["ids"].to_list()))

    return sparse.assemble(gathered_rows.mapInPandas(run, "mat string, row int, col int, val double"), ("mat", "row", "col"))


def _entries(name: str, m: np.ndarray, ids: np.ndarray) -> Iterator[pd.DataFrame]:
    """element matrices as entries, without tiny ones."""
    dofs = (3 * ids[:, :, None] + np.arange(3)).reshape(-1, 30)
    keep = np.abs(m) > 1e-15 * np.abs(m).max(axis=(1, 2), keepdims=True)
    r, c = np.broadcast_arrays(dofs[:, :, None], dofs[:, None, :])
    yield pd.DataFrame({"mat": name, "row": r[keep], "col": c[keep], "val": m[keep]})


def sector_modes(elements: DataFrame, nodes: DataFrame, sets: DataFrame, conditions: DataFrame, sectors: int, modes: int, material: dict[str, float], axis: str = "z", springs: DataFrame | None = None, fixed: DataFrame | None = None, ratios: dict[int, float] | None = None, fluid_density: float = 0.0, **options) -> DataFrame:
    """:func:`solve` from a mesh: matching, assembly, projection, prestress and all.

    ``material``: e, nu, rho, and for temperatures slope and reference (P2); a condition's
    column ``temperature`` scales the modulus. ``springs`` (node_id, kx, ky, kz) are grounded;
    ``fixed`` (dof) is the hub's set by default. Without fixed degrees of freedom there is no
    static solution, and so no stress stiffening. A ``fluid_density`` adds the mass of the
    potential flow about the wetted faces (about z).
    """
    if fluid_density > 0 and axis != "z":
        raise ValueError("added mass is known about z; turn the mesh first (physics.aligned)")
    pairs = mesh.match_boundaries(mesh.in_set(nodes, sets, "left_boundary"), mesh.in_set(nodes, sets, "right_boundary"), sectors, axis)
    base = assembled(elements, nodes, material["e"], material["nu"], material["rho"], axis)
    if springs is not None:
        base = base.unionByName(mesh.spring_diagonal(springs).select(F.lit("K_spring").alias("mat"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "val"))
    base = mesh.checkpointed(base)
    fixed = fixed_dofs(sets) if fixed is None else fixed
    terms = cyclic_terms(base, pairs, sectors, axis)
    if options.get("centrifugal", True) and not fixed.isEmpty():
        u = static_unit(terms, cyclic_load(base, pairs, sectors, axis), fixed)
        sigma = prestress(elements, nodes, full_displacement(u, pairs, nodes, sectors, axis), material["e"], material["nu"])
        terms = terms.unionByName(cyclic_terms(sigma, pairs, sectors, axis))
    if fluid_density > 0:
        wet = mesh.wetted_faces(mesh.boundary_faces(elements), sets)
        added = fluid.added_mass_entries(wet, nodes, fluid_density, sectors, [k for k in (options.get("harmonics") or range(sectors // 2 + 1)) if 0 <= k <= sectors // 2])
        named = added.select(F.concat(F.lit("A"), F.col("k").cast("string")).alias("mat"), "row", "col", "val")
        terms = terms.unionByName(cyclic_terms(named, pairs, sectors, axis))
    if "temperature" in conditions.columns:
        at = physics.scaled_modulus(F.lit(material["e"]), F.lit(material.get("slope", 0.0)), F.col("temperature"), F.lit(material.get("reference", 293.15)))
        conditions = conditions.withColumn("modulus", F.coalesce(at / material["e"], F.lit(1.0)))
    return solve(terms, fixed, conditions, sectors, modes, ratios=ratios, **options)


def quality(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per element, whether it is tangled and the blend that repairs it (null if none)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            x = np.stack(rows["xyz"].to_list()).reshape(-1, 10, 3) if len(rows) else np.zeros((0, 10, 3))
            yield pd.DataFrame({"elem_id": rows["elem_id"], "tangled": element.negative(x), "blend": element.untangled(x)})

    return gathered(elements, nodes).mapInPandas(run, "elem_id int, tangled boolean, blend double").withColumn("blend", F.nanvl("blend", F.lit(None).cast("double")))


def quality_report(rows: DataFrame) -> DataFrame:
    """Counts, and lists of the elements that need and that resist repair."""
    bad = F.when(F.col("tangled"), F.col("elem_id"))
    return rows.agg(F.count("*").alias("elements"), F.count_if("tangled").alias("negative"), F.count_if(F.col("tangled") & F.col("blend").isNotNull()).alias("fixed"), F.array_sort(F.collect_list(bad)).alias("negative_ids"), F.array_sort(F.collect_list(F.when(F.col("blend").isNull(), F.col("elem_id")))).alias("unfixable_ids"))


def annulus_sector(spark, sectors: int = 24, inner: float = 0.05, outer: float = 0.15, height: float = 0.01, radial: int = 2, around: int = 2, axial: int = 1) -> dict[str, DataFrame]:
    """A structured sector of an annulus: boxes in (r, theta, z), six tetrahedra each."""
    grid = (2 * radial + 1, 2 * around + 1, 2 * axial + 1)
    index = np.indices(grid).reshape(3, -1).T
    r = inner + (outer - inner) * index[:, 0] / (grid[0] - 1)
    t = physics.TWO_PI / sectors * index[:, 1] / (grid[1] - 1)
    xyz = np.column_stack([r * np.cos(t), r * np.sin(t), height * index[:, 2] / (grid[2] - 1)])
    name = lambda p: (p[0] * grid[1] + p[1]) * grid[2] + p[2]
    order = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    conn = []
    for box in np.ndindex(radial, around, axial):
        for way in order:  # the six paths from a box's first corner to its last
            corner = [2 * np.array(box)]
            for axis in way:
                corner.append(corner[-1] + 2 * np.eye(3, dtype=int)[axis])
            if np.linalg.det(np.array([corner[i] - corner[0] for i in (1, 2, 3)])) < 0:
                corner[1], corner[2] = corner[2], corner[1]
            conn.append([name(c) for c in corner] + [name((corner[a] + corner[b]) // 2) for a, b in element.EDGES])
    used = np.unique(conn)
    at = np.searchsorted(used, conn)
    index, xyz = index[used], xyz[used]
    sets = {"left_boundary": np.flatnonzero(index[:, 1] == 0), "right_boundary": np.flatnonzero(index[:, 1] == grid[1] - 1), "hub_constraint": np.flatnonzero(index[:, 0] == 0)}
    from ..sources.msh import from_arrays

    return from_arrays(spark, xyz, at, {k: v.tolist() for k, v in sets.items()})


def fixed_dofs(sets: DataFrame, name: str = "hub_constraint") -> DataFrame:
    return sets.where(F.col("set_name") == name).select(F.explode(F.array(*[3 * F.col("node_id") + d for d in range(3)])).alias("dof")).distinct()
