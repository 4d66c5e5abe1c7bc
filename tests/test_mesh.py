import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlake.kernels import eigen, element, fluid
from rotorlake.operators import fem, mesh, sparse
from rotorlake.plans import queries
from rotorlake.sources import msh, results

N = 24


@pytest.fixture(scope="module")
def sector(spark):
    out = fem.annulus_sector(spark)
    return {k: v.persist() for k, v in out.items()}


@pytest.fixture(scope="module")
def matrices(sector):
    return fem.assembled(sector["elements"], sector["nodes"], 2e11, 0.3, 7800.0).persist()


@pytest.fixture(scope="module")
def pairs(sector):
    side = lambda s: mesh.in_set(sector["nodes"], sector["sets"], s)
    return mesh.match_boundaries(side("left_boundary"), side("right_boundary"), N).persist()


def test_every_boundary_node_is_matched(sector, pairs):
    n = sector["sets"].where("set_name = 'left_boundary'").count()
    assert pairs.count() == n == pairs.select("right_id").distinct().count() and pairs.agg(F.max("distance")).first()[0] < 1e-12


def test_unmatched_nodes_stay_out(spark):
    left = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "node_id int, x double, y double, z double")
    a = 2 * math.pi / N
    right = spark.createDataFrame([(5, math.cos(a), math.sin(a), 0.0), (6, 3.0, 0.0, 0.0)], "node_id int, x double, y double, z double")
    assert [(r["left_id"], r["right_id"]) for r in mesh.match_boundaries(left, right, N).collect()] == [(0, 5)]


def test_mass_is_that_of_the_volume(matrices):
    want = 7800.0 * 0.01 * (0.15**2 - 0.05**2) * math.pi / N
    assert abs(fem.mass_of(matrices).first()[0] / want - 1) < 0.02


def test_stiffness_is_symmetric_and_rigid_motion_is_free(sector, matrices):
    rows = matrices.where("mat = 'K'").toPandas()
    n = 3 * sector["nodes"].count()
    k = np.zeros((n, n))
    k[rows["row"], rows["col"]] = rows["val"]
    xyz = sector["nodes"].orderBy("node_id").toPandas()[["x", "y", "z"]].to_numpy()
    turn = np.column_stack([-xyz[:, 1], xyz[:, 0], 0 * xyz[:, 0]]).ravel()
    assert np.allclose(k, k.T, atol=1e-6 * np.abs(k).max())
    for u in (np.tile([1.0, 0, 0], len(xyz)), np.tile([0, 0, 1.0], len(xyz)), turn):
        assert np.abs(k @ u).max() < 1e-7 * np.abs(k).max()


def test_projection_is_the_triple_product(sector, matrices, pairs):
    """Parts with phases against T^H A T for symmetric K and skew G (signs of dropped blocks)."""
    terms = fem.cyclic_terms(matrices.where("mat in ('K', 'G')"), pairs, N).toPandas()
    n, a, k = 3 * sector["nodes"].count(), 2 * math.pi / N, 5
    t = np.eye(n, dtype=complex)
    for r in pairs.collect():
        for d in range(3):
            t[3 * r["right_id"] + d] = 0
        c, s, p = math.cos(a), math.sin(a), np.exp(1j * k * a)
        right, left = 3 * r["right_id"], 3 * r["left_id"]
        t[right : right + 3, left : left + 3] = p * np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    for name in ("K", "G"):
        full = np.zeros((n, n))
        rows = matrices.where(F.col("mat") == name).toPandas()
        full[rows["row"], rows["col"]] = rows["val"]
        got = np.zeros((n, n), complex)
        own = terms[terms["mat"] == name]
        np.add.at(got, (own["row"], own["col"]), own["val"] * np.exp(1j * k * a * own["part"]))
        want = t.conj().T @ full @ t
        assert np.abs(got - want).max() < 1e-9 * np.abs(want).max()


def test_cyclic_modes(spark, sector, matrices, pairs):
    terms = fem.cyclic_terms(matrices, pairs, N)
    speeds = spark.createDataFrame([(0, 0.0), (1, 6000.0)], "cond_id int, rpm double")
    rows = fem.solve(terms, fem.fixed_dofs(sector["sets"]), speeds, N, 4, harmonics=[0, 1, 12, 40]).collect()
    by = {(r["cond_id"], r["k"]): [] for r in rows}
    for r in rows:
        by[r["cond_id"], r["k"]].append(r)
    assert set(by) == {(c, k) for c in (0, 1) for k in (0, 1, 12)} and all(len(v) == 4 for v in by.values())
    assert all(r["residual"] < 1e-6 and r["freq_hz"] > 0 for r in rows)
    one = sorted(by[0, 1], key=lambda r: r["mode_idx"])
    assert [r["whirl"] for r in one] == [1, -1, 1, -1] and one[0]["freq_hz"] == one[1]["freq_hz"]
    assert all(r["whirl"] == 0 for r in by[0, 0])
    split = fem.solve(terms, fem.fixed_dofs(sector["sets"]), speeds.where("rpm > 0"), N, 2, harmonics=[1], coriolis=True).collect()
    assert {r["whirl"] for r in split} == {1, -1} and len(split) == 4


def test_cyclic_sweep_solves_every_harmonic(spark, sf_dir):
    rows = queries.cyclic_sweep(spark, sf_dir).groupBy("rpm").agg(F.sort_array(F.collect_set("k")).alias("k")).collect()
    assert len(rows) == 7 and all(r["k"] == list(range(N // 2 + 1)) for r in rows)


def test_static_solution_grows_with_speed_squared(spark, sector, matrices, pairs):
    terms = fem.cyclic_terms(matrices, pairs, N)
    force = fem.cyclic_load(matrices, pairs, N)
    speeds = spark.createDataFrame([(1000.0,), (2000.0,)], "rpm double")
    u = fem.static_solve(terms, force, fem.fixed_dofs(sector["sets"]), speeds).groupBy("rpm").agg(F.max(F.abs("u")).alias("u")).orderBy("rpm").collect()
    assert math.isclose(u[1]["u"] / u[0]["u"], 4.0, rel_tol=1e-9) and u[0]["u"] > 0


def test_surface_of_a_sector(sector):
    faces = mesh.with_normals(mesh.boundary_faces(sector["elements"]), sector["nodes"])
    area = faces.agg(F.sum("area")).first()[0]
    assert mesh.boundary_edges(mesh.boundary_faces(sector["elements"])).count() == 0
    total = faces.agg(*[F.sum(F.col(f"n{c}") * F.col("area")) for c in "xyz"]).first()
    assert area > 0 and max(map(abs, total)) < 1e-12 * 100
    top = faces.where("nz > 0.99").agg(F.sum("area")).first()[0]
    assert abs(top / ((0.15**2 - 0.05**2) * math.pi / N) - 1) < 0.02
    seed = faces.where("nz > 0.99").limit(1)
    assert mesh.flood_fill(faces, seed, 30.0).count() == faces.where("nz > 0.99").count()
    n = mesh.surface_normal(faces.where("nz > 0.99"), sector["nodes"]).first()
    assert n["nz"] > 0.999


def test_wet_and_hub_faces(sector):
    faces = mesh.with_normals(mesh.boundary_faces(sector["elements"]), sector["nodes"])
    wet = mesh.wetted_faces(faces, sector["sets"])
    assert 0 < wet.count() < faces.count()
    hub = mesh.hub_nodes(faces, sector["nodes"], sector["sets"].where("set_name in ('left_boundary', 'right_boundary')"))
    assert hub.count() > 0


def test_quality_and_repair(spark, sector):
    good = fem.quality(sector["elements"], sector["nodes"])
    assert good.where("tangled").count() == 0
    r = fem.quality_report(good).first()
    assert r["negative"] == 0 and r["unfixable_ids"] == [] and r["elements"] == 24


def test_shape_functions():
    p, w = element.rule()
    assert np.allclose(element.shape(p).sum(axis=1), 1) and np.allclose(element.slope(p).sum(axis=1), 0) and math.isclose(w.sum(), 1 / 6)
    corners = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    nodes = np.vstack([corners, [(corners[a] + corners[b]) / 2 for a, b in element.EDGES]])
    assert np.allclose(element.shape(nodes), np.eye(10), atol=1e-12)
    bad = nodes[None].copy()
    bad[0, 4] = [0.02, 0.45, 0.3]
    assert element.negative(nodes[None]).tolist() == [False] and element.negative(bad).tolist() == [True] and 0 < element.untangled(bad)[0] <= 1


def test_condensation_keeps_static_response():
    r = np.random.default_rng(1)
    a = r.normal(size=(8, 8))
    k, m = a @ a.T + np.eye(8), np.eye(8)
    kr, mr, t = eigen.condense(k, m, np.arange(4))
    f = np.concatenate([r.normal(size=4), np.zeros(4)])
    assert np.allclose(t @ np.linalg.solve(kr, f[:4]), np.linalg.solve(k, f)) and mr.shape == (4, 4)


def test_quadratic_roots_without_damping_are_plain_modes():
    k, m = np.diag([1.0, 4.0, 9.0]).astype(complex), np.eye(3, dtype=complex)
    f, whirl, _ = eigen.quadratic(k, np.zeros((3, 3), complex), m, 3)
    assert np.allclose(f * 2 * np.pi, [1, 1, 2, 2, 3, 3]) and sorted(whirl) == [-1, -1, -1, 1, 1, 1]


def test_elliptic_integrals():
    k, e = fluid.elliptic(np.array([1 / math.sqrt(2), 0.5, 0.0]))
    assert math.isclose(k[0], 1.8540746773013719, rel_tol=1e-14) and math.isclose(e[1], 1.4674622093394272, rel_tol=1e-14) and math.isclose(e[2], math.pi / 2)
    for x in (0.2, 0.7):  # Legendre's relation
        (k1, k2), (e1, e2) = (v.tolist() for v in fluid.elliptic(np.array([x, math.sqrt(1 - x * x)])))
        assert math.isclose(e1 * k2 + e2 * k1 - k1 * k2, math.pi / 2, rel_tol=1e-12)
    with pytest.raises(ValueError, match="modulus"):
        fluid.elliptic(np.array([1.0]))


def test_matrix_rows(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "row int, col int, val double")
    got = {(r["row"], r["col"]): r["val"] for r in sparse.multiply(a, sparse.transpose(a)).collect()}
    assert got == {(0, 0): 5.0, (0, 1): 3.0, (1, 0): 3.0, (1, 1): 9.0}
    same, to_right = sparse.split_by_side(a, spark.createDataFrame([(1,)], "dof int"))
    assert same.count() == 1 and [(r["row"], r["col"]) for r in to_right.collect()] == [(0, 1)]


MSH = """$MeshFormat
2.2 0 8
$EndMeshFormat
$PhysicalNames
1
2 7 "hub" extra
$EndPhysicalNames
$Nodes
10
1 0 0 0
2 1 0 0
3 0 1 0
4 0 0 1
5 .5 0 0
6 .5 .5 0
7 0 .5 0
8 0 0 .5
9 0 .5 .5
10 .5 0 .5
$EndNodes
$Elements
2
1 11 2 9 1 1 2 3 4 5 6 7 8 9 10
2 9 2 7 1 1 2 3 5 6 7
$EndElements
"""


def test_msh_reader(spark, tmp_path):
    path = tmp_path / "a.msh"
    path.write_text(MSH)
    m = msh.load_mesh(spark, str(path))
    assert m["elements"].first()["conn"] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 8]
    assert {r["node_id"] for r in m["sets"].where("set_name = 'hub_constraint'").collect()} == {0, 1, 2, 4, 5, 6}
    spark.dataSource.register(msh.MshSource)
    for at in (str(path), f"file://{path}"):
        assert spark.read.format("msh").option("part", "nodes").load(at).count() == 10
    for wrong in (MSH.replace("2.2 0", "4.1 0"), MSH.replace("2.2 0", "2.2 1"), MSH.replace("1 11 2", "1 99 2"), MSH.replace("2 9 2 7 1 1 2 3 5 6 7", "2 6 2 7 1 1 2 3 5 6 7"), MSH.replace("8 9 10\n2 9", "8 9 77\n2 9")):
        with pytest.raises(msh.MeshError):
            msh.parse(wrong)


def test_units():
    assert results.step_unit("#1=(LENGTH_UNIT()NAMED_UNIT(*)SI_UNIT(.MILLI.,.METRE.));") == 1e-3
    assert results.step_unit("#1=(LENGTH_UNIT()SI_UNIT($,.METRE.));") == 1.0
    assert results.step_unit("CONVERSION_BASED_UNIT('INCH',#5) SI_UNIT(.CENTI.,.METRE.)") == 1e-2
    custom = "1H,,1H;,4Hname,5Hf.igs,3Hsys,3Hpre,32,38,6,308,15,4Hprod,1.0,3,4HINCH,1,0.01;"
    assert results.iges_unit("\n".join(f"{custom[i : i + 72]:<72}G{i:7}" for i in range(0, len(custom), 72))) == 0.0254
    assert results.step_unit("CONVERSION_BASED_UNIT('INCH',#5)") == 0.0254 and results.step_unit("") is None
    body = "1H,,1H;,4Hname,5Hf.igs,3Hsys,3Hpre,32,38,6,308,15,4Hprod,1.0,2,2HMM,1,0.01;"
    assert results.iges_unit("\n".join(f"{body[i : i + 72]:<72}G{i:7}" for i in range(0, len(body), 72))) == 1e-3


def test_result_files(spark, tmp_path, sector):
    from rotorlake.operators import modal

    m = spark.createDataFrame([(0.0, 0, 0, 5.0, 0), (1000.0, 1, 0, 6.5, 0)], "rpm double, k int, mode_idx int, freq_hz double, whirl int")
    results.write_csv(results.campbell_rows(m, N), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["rpm", "harmonic_index", "mode_family", "frequency_hz", "whirl_direction"]
    results.write_results(m, f"{tmp_path}/r")
    assert results.read_results(spark, f"{tmp_path}/r").count() == 2
    c = modal.campbell(m, N)
    results.save_npz(c, f"{tmp_path}/a.npz")
    assert sorted(map(tuple, results.load_npz(spark, f"{tmp_path}/a.npz").collect())) == sorted(map(tuple, c.select("rpm", "k", "family", "freq_hz").collect()))
    shape = sector["nodes"].select("node_id", *[F.lit(1.0).alias(f"u{c}_{p}") for c in "xyz" for p in ("re", "im")])
    results.write_vtu(sector["nodes"], sector["elements"], shape, f"{tmp_path}/a.vtu")
    assert 'NumberOfCells="24"' in open(f"{tmp_path}/a.vtu").read()
