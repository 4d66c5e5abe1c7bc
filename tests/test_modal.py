import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlake.functions import physics
from rotorlake.kernels import tracking
from rotorlake.operators import modal, response
from rotorlake.plans import queries

MODE = "rpm double, k int, mode_idx int, freq_hz double, whirl int"


def modes(spark, rows):
    return spark.createDataFrame(rows, MODE)


def test_stationary_split_golden(spark):
    m = modes(spark, [(6000.0, 3, 0, 500.0, 0), (6000.0, 3, 1, 1000.0, 0)])
    got = [(r["freq_hz"], r["whirl"]) for r in modal.campbell(m, 24).orderBy("family").collect()]
    assert got == [(200.0, -1), (700.0, -1), (800.0, 1), (1300.0, 1)]


def test_no_split_at_rest_or_without_diameters(spark):
    m = modes(spark, [(6000.0, 0, i, 100.0 * (i + 1), 0) for i in range(3)] + [(0.0, 3, 0, 70.0, 0), (6000.0, 12, 0, 70.0, 0)])
    assert all(r["whirl"] == 0 for r in modal.stationary_split(m, 24).collect())


def test_labelled_modes_shift_by_their_whirl(spark):
    m = modes(spark, [(6000.0, 3, 0, 500.0, 1), (6000.0, 3, 1, 100.0, -1), (6000.0, 3, 2, 10.0, 0)])
    assert sorted((r["freq_hz"], r["whirl"]) for r in modal.stationary_split(m, 24).collect()) == [(10.0, 0), (200.0, -1), (800.0, 1)]


def test_odd_sector_count_does_not_split_the_top_harmonic(spark):
    m = modes(spark, [(6000.0, 3, 0, 500.0, 0)])
    assert modal.stationary_split(m, 7).count() == 1 and modal.stationary_split(m, 8).count() == 2


def test_engine_order_aliasing(spark):
    m = modes(spark, [(0.0, k, 0, 1000.0 + 100 * k, 0) for k in range(6)])
    hit = lambda eo: [r["k"] for r in modal.excited(m, spark.createDataFrame([(eo,)], "eo int"), 24).collect()]
    assert (hit(3), hit(5), hit(7), hit(21)) == ([3], [5], [], [3])
    assert spark.range(1).select(physics.excites(F.lit(3), F.lit(3), 0)).first()[0] is False


def test_crossing_is_interpolated(spark):
    m = modes(spark, [(0.0, 0, 0, 100.0, 0), (12000.0, 0, 0, 100.0, 0)])
    (r,) = modal.crossings(m, spark.createDataFrame([(1,)], "eo int")).collect()
    assert (r["cross_rpm"], r["cross_hz"]) == (6000.0, 100.0)


def test_tracking_follows_swapped_modes_and_gaps(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(1, 0.0, 0, a), (1, 0.0, 1, b), (1, 2000.0, 0, b), (1, 2000.0, 1, a), (1, 5000.0, 0, a), (1, 5000.0, 1, b)]
    s = spark.createDataFrame(rows, "k int, rpm double, mode_idx int, shape array<double>")
    got = {(r["rpm"], r["track"]): r["mode_idx"] for r in modal.track(modal.mac_neighbours(s)).collect()}
    assert got == {(0.0, 0): 0, (0.0, 1): 1, (2000.0, 0): 1, (2000.0, 1): 0, (5000.0, 0): 0, (5000.0, 1): 1}


def test_tracking_from_shapes_is_that_from_all_pairs(spark, monkeypatch):
    """Tied MACs, tracks that get lost, speeds with more and fewer modes, a harmonic of one speed."""
    r = np.random.default_rng(4)
    sizes = [(k, rpm, n) for k, counts in enumerate(((40, 30, 45, 20), (25, 60, 25), (7,))) for rpm, n in enumerate(counts)]
    rows = [(k, 1000.0 * rpm, i, r.integers(-1, 2, 4).astype(float).tolist()) for k, rpm, n in sizes for i in range(n)]
    s = spark.createDataFrame(rows, "k int, rpm double, mode_idx int, shape array<double>")
    want = {tuple(x) for x in modal.track(modal.mac_neighbours(s)).collect()}
    assert {tuple(x) for x in modal.tracked(s).collect()} == want and len(want) == 4 * 40 + 3 * 25 and any(m < 0 for *_, m in want)
    a, b = (r.integers(-1, 2, (n, 4)).astype(float) for n in (50, 45))
    a[3] = np.nan
    out = tracking.assigned(np.arange(50), a, b)
    monkeypatch.setattr(tracking, "KEPT", 2)
    assert tracking.assigned(np.arange(50), a, b) == out and sorted(out.values()) == list(range(45))


def test_mode_tracking_makes_no_rows_of_pairs(spark, sf_dir):
    plan = queries.mode_tracking(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "embedding" in plan


def test_mode_tracking_takes_every_shape(spark, tmp_path):
    rows = [(i, 1, [1.0, 0.0] if i < 707 else [0.0, 1.0]) for i in range(700, 714)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["rpm"], r["track"], r["mode_idx"]) for r in queries.mode_tracking(spark, str(tmp_path)).collect()}
    assert got == {(1000.0 * i, t, t) for i in range(7) for t in (0, 1)}


def test_mac_identities(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 12) for r in df.select(modal.mac(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_padded_table(spark):
    m = modes(spark, [(0.0, 0, 0, 5.0, 0), (0.0, 0, 1, 7.0, 0), (1000.0, 0, 0, 6.0, 0)])
    table, rpm, k = modal.padded(modal.campbell(m, 24))
    assert rpm == [0.0, 1000.0] and k == [0] and np.isnan(table[1, 0, 1]) and table[0, 0].tolist() == [5.0, 7.0]


@pytest.mark.parametrize(("kind", "mode", "omega", "want"), [("NONE", 0, 1.0, 0.0), ("MODAL", 100, 1.0, 0.03), ("MODAL", 0, 1.0, 0.01), ("RAYLEIGH", 0, 1000.0, 0.01), ("RAYLEIGH", 0, 0.0, 0.0)])
def test_damping(spark, kind, mode, omega, want):
    z = physics.damping(F.lit(kind), F.array(F.lit(0.01), F.lit(0.02), F.lit(0.03)), F.lit(10.0), F.lit(1e-5), F.lit(mode), F.lit(omega))
    assert math.isclose(spark.range(1).select(z).first()[0], want, abs_tol=1e-15)


def test_added_mass_factors(spark):
    one = F.lit(1.0)
    ratio = lambda n: spark.range(1).select(physics.kwak_gamma(F.lit(n)), physics.added_mass_ratio(F.lit(n), one, one, one, one)).first()
    known = [0.6526, 0.3910, 0.2737, 0.2078, 0.1660, 0.1372, 0.1163, 0.1003, 0.0878, 0.0777, 0.0695]
    assert [ratio(n)[0] for n in range(11)] == known and math.isclose(ratio(11)[0], 0.65 / 11.05**0.85)
    assert math.isclose(ratio(2)[1], 1 / math.sqrt(1.2737))
    with pytest.raises(Exception, match="negative"):
        ratio(-1)


def test_modal_frf_closed_form(spark):
    m = spark.createDataFrame([(800.0, 3.0, -2.0)], "freq_hz double, q_re double, q_im double")
    for r in response.frf(m, 200, F.lit(0.015), F.lit(400.0), F.lit(1200.0)).collect():
        w, wr = 2 * math.pi * r["f_hz"], 2 * math.pi * 800.0
        want = (3 - 2j) / (wr**2 - w**2 + 2j * 0.015 * wr * w)
        assert abs(complex(r["h_re"], r["h_im"]) - want) <= 1e-10 * abs(want)
    (p,) = response.peak(response.frf(m, 401, F.lit(0.015), F.lit(400.0), F.lit(1200.0)), ["freq_hz"]).collect()
    assert p["peak_hz"] == 800.0


def test_modal_force_is_not_conjugated(spark):
    shape = spark.createDataFrame([(0, 0, 0, 1.0, 1.0)], "mode int, node_id int, d int, re double, im double")
    force = spark.createDataFrame([(0, 0, 3.0, 4.0)], "node_id int, d int, re double, im double")
    r, h = response.modal_forces(shape, force, ["mode"]).first(), response.modal_forces(shape, force, ["mode"], hermitian=True).first()
    assert (r["q_re"], r["q_im"]) == (-1.0, 7.0) and (h["q_re"], h["q_im"]) == (7.0, 1.0)


def test_tuned_pattern_keeps_frequencies_and_mistuned_ones_are_bounded(spark):
    tuned = [500.0 + 100 * i for i in range(13)]
    flat = spark.range(24).select(F.lit(0).cast("long").alias("pattern"), F.col("id").cast("int").alias("blade"), F.lit(0.0).alias("delta"))
    got = sorted(r["freq_hz"] for r in response.mistuned(flat, tuned, 24).collect())
    assert np.allclose(got, sorted(tuned + tuned[1:12]), atol=0.1)
    rows = response.mistuned(response.random_patterns(spark, 20, 24, 0.05, 1), tuned, 24).collect()
    assert len(rows) == 480 and max(r["magnification"] for r in rows) <= math.sqrt(24) + 1e-9 and all(0.99 <= r["ipr"] <= 24.01 for r in rows)


def test_diagnostics_with_missing_values(spark):
    t = spark.createDataFrame([(0, 0, 100.0), (0, 1, float("nan")), (1, 0, 0.0), (1, 1, 50.0)], "nd int, j int, freq_hz double")
    c = spark.createDataFrame([(0, 0, 110.0), (0, 1, 5.0), (1, 0, 5.0)], "nd int, j int, freq_hz double")
    rel = response.errors(t, c)
    stats = {r["nd"]: (round(r["mean_err"], 9), r["n_modes"]) for r in response.error_stats(rel).collect()}
    w = response.worst(rel).first()
    assert stats == {0: (10.0, 1), 1: (0.0, 0)} and (w["nd"], w["j"], round(w["rel"], 9)) == (0, 0, 10.0)


def test_nodal_circles(spark):
    rows = [(1, r, t, math.cos(2.5 * math.pi * (r - 0.1) / 0.9)) for r in np.linspace(0.1, 1.0, 200).tolist() for t in np.linspace(0.0, 0.26, 30).tolist()] + [(2, 1.0, 0.0, 1.0)]
    got = {r["mode"]: r["circles"] for r in response.nodal_circles(spark.createDataFrame(rows, "mode long, r double, theta double, value double")).collect()}
    assert got == {1: 2, 2: 0} or got == {1: 3, 2: 0}
