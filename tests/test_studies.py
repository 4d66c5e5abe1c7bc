import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlake.functions import physics
from rotorlake.kernels import eigen, element, fluid, nearest
from rotorlake.operators import detect, fem, mesh, studies

N = 24
STEEL = {"e": 2e11, "nu": 0.3, "rho": 7800.0}


@pytest.fixture(scope="module")
def sector(spark):
    return {k: v.persist() for k, v in fem.annulus_sector(spark, height=0.003, radial=2, around=1).items()}


def frequencies(spark, sector, conditions, **options):
    axis = options.get("axis", "z")
    rows = fem.sector_modes(sector["elements"], sector["nodes"], sector["sets"], conditions, N, 2, options.pop("material", STEEL), harmonics=[0, 2], **options).collect()
    assert {r["status"] for r in rows} == {"solved"}, axis
    return {(r["cond_id"], r["k"], r["mode_idx"]): r["freq_hz"] for r in rows}


def test_rotation_stiffens_bending(spark, sector):
    speeds = spark.createDataFrame([(0, 0.0), (1, 6000.0)], "cond_id int, rpm double")
    f = frequencies(spark, sector, speeds)
    soft = frequencies(spark, sector, speeds, fixed=spark.createDataFrame([], "dof int"), floor_hz=20.0)
    for k in (0, 2):
        assert f[1, k, 0] > f[0, k, 0] * 1.01
    assert all(soft[1, k, 0] <= soft[0, k, 0] * 1.0001 for k in (0, 2))


def test_stress_stiffness_of_uniform_stress():
    corners = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    x = np.vstack([corners, [(corners[a] + corners[b]) / 2 for a, b in element.EDGES]])[None]
    strain = np.diag([1e-3, 2e-3, -1e-3])
    m = element.stress_stiffness(x, (x @ strain).reshape(1, 30), 2e11, 0.3)[0]
    s = element.stiffness_law(2e11, 0.3) @ np.array([1e-3, 2e-3, -1e-3, 0, 0, 0])
    gradient = np.array([[0.1, 0.2, -0.3], [0.0, 0.4, 0.1], [0.3, 0.0, 0.2]])
    v = (x[0] @ gradient.T).ravel()
    assert math.isclose(v @ m @ v, np.einsum("ij,jk,ik->", gradient, np.diag(s[:3]), gradient) / 6, rel_tol=1e-9)


def test_temperature_springs_and_fluid(spark, sector):
    cold = spark.createDataFrame([(0, 0.0, 293.15), (1, 0.0, 893.15)], "cond_id int, rpm double, temperature double")
    f = frequencies(spark, sector, cold, material=STEEL | {"slope": -1e8, "reference": 293.15}, ratios={2: 0.5, 0: 1.5})
    assert math.isclose(f[1, 0, 0] / f[0, 0, 0], math.sqrt(0.7), rel_tol=1e-6)
    one = spark.createDataFrame([(0, 0.0)], "cond_id int, rpm double")
    springs = sector["nodes"].select("node_id", F.lit(0.0).alias("kx"), F.lit(0.0).alias("ky"), F.lit(1e4).alias("kz"))
    base, held = frequencies(spark, sector, one), frequencies(spark, sector, one, springs=springs)
    assert math.isclose(f[0, 2, 0], base[0, 2, 0] / 2, rel_tol=1e-6) and held[0, 0, 0] > base[0, 0, 0] * 1.01


@pytest.mark.parametrize("axis", ["x", "y"])
def test_other_axes_give_the_same_modes(spark, sector, axis):
    """The mesh with its coordinates exchanged, so that its axis lies along x or y."""
    names = {"x": "zxy", "y": "yzx"}[axis]
    turned = sector | {"nodes": sector["nodes"].select("node_id", *[F.col(c).alias(to) for c, to in zip(names, "xyz", strict=True)])}
    one = spark.createDataFrame([(0, 3000.0)], "cond_id int, rpm double")
    f, g = frequencies(spark, sector, one), frequencies(spark, turned, one, axis=axis)
    assert all(math.isclose(f[key], g[key], rel_tol=1e-6) for key in f)


def test_equally_near_nodes_are_matched_once(spark):
    """Two nodes at one place on either side: a greedy step matches what mutual neighbours leave over."""
    a = 2 * math.pi / N
    left = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0)], "node_id int, x double, y double, z double")
    right = spark.createDataFrame([(8, math.cos(a), math.sin(a), 0.0), (9, math.cos(a), math.sin(a), 0.0)], "node_id int, x double, y double, z double")
    assert sorted((r["left_id"], r["right_id"]) for r in mesh.match_boundaries(left, right, N).collect()) == [(0, 8), (1, 9)]


def test_boundaries_from_geometry(spark, sector):
    names = lambda sets, n: {r["node_id"] for r in sets.where(F.col("set_name") == n).collect()}
    placed, found = detect.detected_sets(sector["elements"], sector["nodes"], N)
    for n in ("left_boundary", "right_boundary"):
        assert names(found, n) == names(sector["sets"], n)
    assert names(found, "free_boundary") and placed.count() == sector["nodes"].count()
    left, right, free = detect.named_boundaries(sector["sets"])
    assert left.count() == right.count() > 0 and free.count() == 0
    with pytest.raises(ValueError, match="right_boundary"):
        detect.named_boundaries(sector["sets"].where("set_name = 'left_boundary'"))
    with pytest.raises(ValueError, match="no surface nodes"):
        detect.detected_sets(sector["elements"], sector["nodes"], 7, tolerance=1e-6)


def test_sector_sides_takes_few_cells_and_misses_no_pair(spark):
    """Random surfaces denser than the tolerance against all pairs; about two cells a turned node, not 27."""
    r, tolerance, a = np.random.default_rng(5), 0.05, 2 * math.pi / 8
    own = r.uniform(-1, 1, (1500, 3)) * [0.5, 0.5, 0.1]
    s = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(own)] + [(-1, float("nan"), 0.0, 0.0), (-2, None, 0.0, 0.0)], "node_id int, x double, y double, z double").persist()
    turned = np.column_stack([own[:, 0] * math.cos(a) - own[:, 1] * math.sin(a), own[:, 0] * math.sin(a) + own[:, 1] * math.cos(a), own[:, 2]])
    d = np.sqrt(((turned[:, None] - own[None]) ** 2).sum(axis=2))
    want: dict[int, int] = {}
    for left in np.flatnonzero(d.min(axis=1) <= tolerance).tolist():
        want.setdefault(int(d[left].argmin()), left)
    out = detect.sector_sides(s, 8, tolerance)
    assert {x["right_id"]: x["left_id"] for x in out.collect()} == want and len(want) > 300
    cells = detect.turned_cells(s, 8, tolerance)
    assert cells.where("left_id >= 0").count() < 5 * len(own) and cells.where("left_id >= 0").select("left_id").distinct().count() == len(own)


def test_sector_sides_broadcasts_no_nodes(spark):
    """Places made from a range of ids, a source that Catalyst takes for small enough to broadcast."""
    i, a = F.col("id"), 2 * math.pi / N
    own = spark.range(4000).select(i.alias("node_id"), (i % 17 / 10.0 + 0.5).alias("x"), (i % 23 / 10.0 + 0.25).alias("y"), F.floor(i / 391).cast("double").alias("z"))
    turned = own.select(F.col("node_id") + 10_000, F.col("x") * math.cos(a) - F.col("y") * math.sin(a), F.col("x") * math.sin(a) + F.col("y") * math.cos(a), "z")
    out = detect.sector_sides(own.union(turned), N, 1e-3)
    assert sorted((x["left_id"], x["right_id"]) for x in out.collect()) == [(n, n + 10_000) for n in range(4000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_chain_and_nearest_panel(spark):
    edges = spark.createDataFrame([(5, 3), (1, 2), (2, 5)], "a int, b int")
    assert detect.chain(edges) == [1, 2, 5, 3] and detect.chain(edges.limit(0)) == []
    assert detect.chain(edges.union(spark.createDataFrame([(3, 1)], "a int, b int"))) == [1, 2, 5, 3]
    r = np.random.default_rng(2)
    points, own = r.uniform(0, 5, (200, 2)), np.vstack([r.uniform(0, 0.4, (60, 2)), [[4.9, 4.9]]])
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "point_id int, r double, z double")
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(own)], "panel_id int, r_mid double, z_mid double")
    got = {x["point_id"]: (x["panel_id"], x["distance"]) for x in mesh.nearest_panel(p, q).collect()}
    d = np.linalg.norm(points[:, None] - own[None], axis=2)
    assert len(got) == 200 and all(got[i][0] == d[i].argmin() and math.isclose(got[i][1], d[i].min()) for i in range(200))
    assert mesh.nearest_panel(p, q.limit(0)).count() == 0


def test_nearest_panel_of_far_points_looks_at_few_panels(spark, monkeypatch):
    """Points far from all panels, many panels at one place, a ring with its centre, rows without a place."""
    n = np.arange(4000)
    own = np.column_stack([1 + n % 37 / 10, n % 53 / 10])
    points = np.column_stack([np.arange(300) % 30 / 10, np.arange(300) * 2.0])
    looked = []
    leaf = nearest.Places._in_leaf
    monkeypatch.setattr(nearest.Places, "_in_leaf", lambda self, p, at: (looked.append(len(p)), leaf(self, p, at))[1])
    d = np.sqrt(((points[:, None] - own[None]) ** 2).sum(axis=2))
    distance, number = nearest.Places(*own[:1961].T).search(*points.T)
    assert (distance == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all() and sum(looked) * nearest.LEAF < 100 * len(points)
    turn = np.arange(1000) / 1000 * 2 * math.pi
    monkeypatch.setattr(nearest, "FRONT", 64)
    assert nearest.Places(np.cos(turn) * 0 + 2.0, turn).search([2.0, 9.0], [turn[70], turn[7]])[1].tolist() == [70, 7]
    assert nearest.Places(np.cos(turn).round(), np.sin(turn).round()).search([0.0], [0.0])[1].tolist() == [0]
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)] + [(-1, float("nan"), 0.0), (-2, None, 0.0)], "point_id int, r double, z double")
    q = spark.createDataFrame([(f"{i:04}", *map(float, x)) for i, x in enumerate(own)] + [("", float("nan"), 1.0), ("", float("inf"), 1.0)], "panel_id string, r_mid double, z_mid double")
    monkeypatch.setattr(mesh, "PANEL_PLACES", 700)
    got = {x["point_id"]: (int(x["panel_id"]), x["distance"]) for x in mesh.nearest_panel(p, q).collect()}
    assert got == {i: (d[i].argmin(), d[i].min()) for i in range(300)}


def test_modes_get_names(spark):
    grid = [(i, float(r), float(t)) for i, (r, t) in enumerate((r, t) for r in np.linspace(0.1, 1.0, 80) for t in np.linspace(0.0, 0.26, 12))]
    nodes = spark.createDataFrame([(i, r * math.cos(t), r * math.sin(t), 0.0) for i, r, t in grid], "node_id int, x double, y double, z double")
    phase = complex(math.cos(1.1), math.sin(1.1))
    rows = []
    for i, r, t in grid:
        axial = (math.cos(1.5 * math.pi * (r - 0.1) / 0.9)) * phase
        rows += [(1, i, 0.0, 0.0, 0.0, 0.0, axial.real, axial.imag), (2, i, -math.sin(t), 0.0, math.cos(t), 0.0, 0.01, 0.0)]
    shapes = spark.createDataFrame(rows, "mode long, node_id int, ux_re double, ux_im double, uy_re double, uy_im double, uz_re double, uz_im double")
    modes = spark.createDataFrame([(1, 2, 300.0), (2, 0, 500.0)], "mode long, k int, freq_hz double")
    got = {r["mode"]: r for r in studies.identify_modes(shapes, nodes, modes, 0.5).collect()}
    assert (got[1]["family"], got[1]["circles"], got[1]["label"]) == ("B", 1, "2B") or (got[1]["family"], got[1]["circles"], got[1]["label"]) == ("B", 2, "3B")
    assert got[2]["family"] == "T" and math.isclose(got[1]["velocity"], 2 * math.pi * 300 * 0.5 / 2) and got[2]["velocity"] == 0.0


def test_no_excited_mode_gives_empty_tables(spark):
    modes = spark.createDataFrame([(1, 0, 100.0)], "k int, mode_idx int, freq_hz double")
    shapes = spark.createDataFrame([(1, 0, 0, 2, 1.0, 0.0)], "k int, mode_idx int, node_id int, d int, re double, im double")
    force = spark.createDataFrame([(0, 2, 3.0, 0.0)], "node_id int, d int, re double, im double")
    peaks, sweep = studies.forced_response(modes, shapes, force, 5, N, F.lit(0.01), 11)
    assert peaks.count() == sweep.count() == 0
    peaks, sweep = studies.forced_response(modes, shapes, force, 25, N, F.lit(0.01), 101, 50.0, 150.0)
    assert sweep.count() == 101 and peaks.first()["resonance_hz"] == 100.0 and peaks.first()["q_re"] == 3.0


def test_constraint_groups(spark, sector):
    faces = mesh.with_normals(mesh.boundary_faces(sector["elements"]), sector["nodes"])
    specs = [{"type": "fixed", "node_ids": [0]}, {"type": "Frictionless", "point": (0, 0, 0.003), "normal": (0, 0, 1), "tolerance": 1e-9}, {"type": "elastic_support", "node_ids": [1], "stiffness": (1.0, 0.0, 2.0)}, {"type": "displacement", "node_ids": [2], "locked": (True, False, True)}]
    groups, springs = mesh.constraint_groups(specs, sector["nodes"], faces)
    fixed = {(r["node_id"], r["d"]) for r in mesh.constrained(groups).collect()}
    assert {(0, 0), (0, 1), (0, 2), (2, 0), (2, 2)} <= fixed and (1, 0) not in {x for x in fixed if x[0] == 1} and all(d == 2 for n, d in fixed if n not in (0, 2))
    assert [tuple(r) for r in springs.collect()] == [(1, 1.0, 0.0, 2.0)] and mesh.spring_diagonal(springs).count() == 2
    for wrong, message in (({"type": "glued", "node_ids": [0]}, "unknown type"), ({"type": "elastic_support", "node_ids": [0]}, "stiffness")):
        with pytest.raises(ValueError, match=message):
            mesh.constraint_groups([wrong], sector["nodes"], faces)
    assert mesh.constrained(mesh.constraint_groups([], sector["nodes"], faces)[0]).count() == 0


def test_wetted_surface_set(spark, sector):
    faces = mesh.boundary_faces(sector["elements"])
    some = faces.limit(1).first()
    sets = spark.createDataFrame([("wetted_surface", n) for n in some["nodes"][:3]], "set_name string, node_id int")
    assert [(r["elem_id"], r["face_idx"]) for r in mesh.wetted_faces(faces, sets).collect()] == [(some["elem_id"], some["face_idx"])]


def test_memory_model():
    for free, modes, bytes_ in ((10**6, 10, 1e9), (100, 10, 1e9), (10**6, 4, 1e3)):
        n = physics.target_dofs(free, modes, bytes_)
        cost = lambda n, v=4 * modes + 1: 800.0 * n ** (4 / 3) + 32.0 * n * min(v, n)
        assert 1 <= n <= free and (n == free or n == 1 or cost(n) <= bytes_ * 1.01 and cost(n + 2) >= bytes_ * 0.99)
    assert physics.rotation_4x4("z", math.pi / 2)[:2] == pytest.approx([0.0, -1.0], abs=1e-15)


def test_added_mass_of_a_sphere():
    t = np.linspace(0, np.pi, 65)
    r, z = 0.1 * np.sin(t), 0.1 * np.cos(t)
    dr, dz = np.diff(r), np.diff(z)
    size = np.hypot(dr, dz)
    panels = {"r_mid": (r[1:] + r[:-1]) / 2, "z_mid": (z[1:] + z[:-1]) / 2, "nr": -dz / size, "nz": dr / size, "len": size}
    m = fluid.added_mass(1, panels, 1000.0)
    moved = panels["r_mid"] / 0.1
    assert np.allclose(m, m.T) and abs(0.5 * moved @ m @ moved / (2 / 3 * math.pi * 1000.0 * 0.1**3) - 1) < 0.1


def test_plate_frequencies_are_those_of_the_tables(spark):
    """A ring clamped inside (half the radius) and free outside: lambda squared by nodal diameter (Leissa, 1969)."""
    plate = fem.annulus_sector(spark, inner=0.1, outer=0.2, height=0.004, radial=7, around=2)
    one = spark.createDataFrame([(0, 0.0)], "cond_id int, rpm double")
    rows = fem.sector_modes(plate["elements"], plate["nodes"], plate["sets"], one, N, 1, STEEL, harmonics=[0, 1, 2, 3]).collect()
    stiff = 2e11 * 0.004**3 / (12 * (1 - 0.09))
    for k, known in enumerate((13.02, 13.29, 14.70, 18.56)):
        want = known / (2 * math.pi * 0.2**2) * math.sqrt(stiff / (7800.0 * 0.004))
        assert abs(next(r["freq_hz"] for r in rows if r["k"] == k) / want - 1) < (0.15 if k == 3 else 0.1)


def test_lanczos_finds_what_the_dense_solver_finds():
    r = np.random.default_rng(4)
    a = r.normal(size=(260, 260)) + 1j * r.normal(size=(260, 260))
    k, b = a @ a.conj().T, r.normal(size=(260, 260)) * 0.02
    m = np.eye(260) + b @ b.T
    values, x, residual = eigen.hermitian(k, m, 8)
    known = np.linalg.eigvalsh(np.linalg.solve(np.linalg.cholesky(m), np.linalg.solve(np.linalg.cholesky(m), k).conj().T))[:8]
    assert np.allclose(values, known, rtol=1e-7) and residual.max() < 1e-6
    assert np.allclose(x.conj().T @ m @ x, np.eye(8), atol=1e-8)
    twice = np.kron(np.diag(np.arange(1.0, 131.0)), np.eye(2))
    assert np.allclose(eigen.hermitian(twice, np.eye(260), 6)[0], [1, 1, 2, 2, 3, 3], rtol=1e-8)


def test_fluid_adds_mass(spark):
    sector = fem.annulus_sector(spark, height=0.03, radial=3, around=1)
    one = spark.createDataFrame([(0, 0.0)], "cond_id int, rpm double")
    dry, wet = frequencies(spark, sector, one), frequencies(spark, sector, one, fluid_density=1000.0)
    assert all(0.1 * dry[key] < wet[key] < dry[key] * 1.0001 for key in dry) and wet[0, 2, 0] < 0.98 * dry[0, 2, 0]
    with pytest.raises(ValueError, match="about z"):
        frequencies(spark, sector, one, fluid_density=1000.0, axis="x")


def test_outline_of_a_sector(spark, sector):
    from rotorlake.operators import fluid as flow

    wet = mesh.wetted_faces(mesh.boundary_faces(sector["elements"]), sector["sets"])
    profile = flow.meridional_profile(wet, sector["nodes"])
    corners = {(0.05, 0.0), (0.05, 0.003), (0.15, 0.0), (0.15, 0.003)}
    assert corners & {(round(r, 9), round(z, 9)) for r, z in profile.tolist()} and len(profile) >= 4
    assert flow.added_mass_entries(wet.limit(0), sector["nodes"], 1000.0, N, [0, 1]).count() == 0


def test_a_harmonic_that_fails_gives_a_row(spark):
    terms = spark.createDataFrame([("K", 0, 0, 0, 1.0), ("K", 0, 1, 1, 2.0), ("M", 0, 0, 0, 1.0), ("M", 0, 1, 1, -1.0)], "mat string, part int, row int, col int, val double")
    rows = fem.solve(terms, spark.createDataFrame([], "dof int"), spark.createDataFrame([(3, 0.0)], "cond_id int, rpm double"), N, 1, harmonics=[0]).collect()
    assert [(r["cond_id"], r["k"], r["freq_hz"]) for r in rows] == [(3, 0, None)] and "definite" in rows[0]["status"]
