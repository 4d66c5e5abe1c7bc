"""Registered queries of detection and of whole studies, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import physics
from ..operators import detect, modal, response, sparse, studies
from . import views
from .queries import query, rounded
from .views import MODAL, NODES, SECTORS, TRIPLETS, TRUTH

TWO_PI = repr(physics.TWO_PI)
_BY_MODE = f"{MODAL}, m as (select k, mode_idx, min(freq_hz) as freq_hz from modal group by all)"
_PARTS = "e as (select vec_id, label as k, (vec_id % 7 + 1)::int as mode_idx, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings), p as (select vec_id, k, mode_idx, i // 2 as n, max(case when i % 2 = 0 then v end) as re, max(case when i % 2 = 1 then v end) as im from e group by all)"


def _by_mode(spark, d):
    return views.modal(spark, d).groupBy("k", "mode_idx").agg(F.min("freq_hz").alias("freq_hz"))


def _shapes(spark, d):
    """k, mode_idx, node_id, d, re, im: 32 nodes that move along z."""
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("node_id"), F.get("shape", 2 * i).alias("re"), F.get("shape", 2 * i + 1).alias("im")))).alias("p")
    s = views.shapes(spark, d).select("k", (F.col("vec_id") % 7 + 1).cast("int").alias("mode_idx"), parts)
    return s.select(F.col("k").cast("int").alias("k"), "mode_idx", "p.node_id", F.lit(2).alias("d"), "p.re", "p.im")


@query(
    f"""with {_BY_MODE}, {_PARTS}, q as (select k, mode_idx, sum(re * cos(n) - im * sin(n)) as q_re, sum(re * sin(n) + im * cos(n)) as q_im from p group by all),
 own as (select m.*, coalesce(q_re, 1.0) as q_re, coalesce(q_im, 0.0) as q_im from m left join q using (k, mode_idx) where k % {SECTORS} in (5, {SECTORS} - 5)), ends as (select 0.5 * min(freq_hz) as low, 1.5 * max(freq_hz) as high from own),
 f as (select own.*, i, low + (high - low) * i / 100 as f_hz from own, ends, (select unnest(range(101)) as i)),
 h as (select *, sqrt(q_re * q_re + q_im * q_im) / sqrt(pow(pow(freq_hz * {TWO_PI}, 2) - pow(f_hz * {TWO_PI}, 2), 2) + pow(2 * 0.01 * freq_hz * {TWO_PI} * f_hz * {TWO_PI}, 2)) as a from f)
 select k, mode_idx, round(q_re, 6) as q_re, round(q_im, 6) as q_im, round(max(a) * 1e6, 3) as amplitude, round(arg_min(f_hz, struct_pack(a := -round(a * 1e6, 6), f := f_hz)), 6) as resonance_hz from h group by k, mode_idx, q_re, q_im"""
)
def forced_response(spark, d):
    """Engine order 5 along z."""
    force = spark.range(32).select(F.col("id").cast("int").alias("node_id"), F.lit(2).alias("d"), F.cos("id").alias("re"), F.sin("id").alias("im"))
    peaks, _ = studies.forced_response(_by_mode(spark, d), _shapes(spark, d), force, 5, SECTORS, F.lit(0.01), 101)
    return rounded(peaks, "q_re", "q_im", "resonance_hz").select("k", "mode_idx", "q_re", "q_im", F.round(F.col("max_amplitude") * 1e6, 3).alias("amplitude"), "resonance_hz")


@query(f"with {_BY_MODE} select count(*) as modes from m where k % {SECTORS} in (5, {SECTORS} - 5)")
def excited_count(spark, d):
    """A29."""
    return studies.excited_count(_by_mode(spark, d), 5, SECTORS)


_POINTS = f"{MODAL}, z as (select least(k % {SECTORS}, {SECTORS} - k % {SECTORS})::int as nd, mode_idx as family, freq_hz, whirl from modal)"


def _points(spark, d):
    return views.modal(spark, d).select(physics.folded(F.col("k"), SECTORS).cast("int").alias("nd"), F.col("mode_idx").alias("family"), "freq_hz", "whirl")


@query(f"with {_POINTS} select direction, family, nd, min(freq_hz) as freq_hz from (select 'FW' as direction, * from z where whirl in (0, 1) union all select 'BW', * from z where whirl in (0, -1)) group by all")
def zzenf_lines(spark, d):
    """U15, W7."""
    return studies.zzenf_lines(_points(spark, d), SECTORS)


@query(f"with {_POINTS} select family, max(nd) as nd, arg_max(freq_hz, struct_pack(nd := nd, f := freq_hz)) as freq_hz from z group by family")
def label_points(spark, d):
    """W9."""
    return studies.label_points(_points(spark, d))


@query(
    f"""with {_POINTS}, l as (select 'FW' as direction, family, nd, min(freq_hz) as f from z where whirl in (0, 1) group by all union all select 'BW', family, nd, min(freq_hz) from z where whirl in (0, -1) group by all),
 pairs as (select *, lead(nd) over w as nd2, lead(f) over w as f2 from l window w as (partition by direction, family order by nd)), e as (select e, least(e % {SECTORS}, {SECTORS} - e % {SECTORS}) as nd, e * 3000.0::double / 60 as hz from (select unnest(range(0, 20)) as e)),
 s as (select *, lead(nd) over (order by e) as nd2, lead(hz) over (order by e) as hz2 from e), r as (select least(nd, nd2) as nd, case when nd2 > nd then hz else hz2 end as a, case when nd2 > nd then hz2 else hz end as b from s where abs(nd2 - nd) = 1),
 x as (select direction, family, nd, f - a as d1, f2 - b as d2, f, f2 from pairs join r using (nd) where pairs.nd2 = pairs.nd + 1)
 select direction, family, nd, round(nd + abs(d1) / (abs(d1) + abs(d2)), 6) as cross_nd, round(f + abs(d1) / (abs(d1) + abs(d2)) * (f2 - f), 6) as cross_hz from x where d1 * d2 < 0"""
)
def zigzag_crossings(spark, d):
    """At 3000 rpm, up to 900 Hz."""
    lines = studies.zzenf_lines(_points(spark, d), SECTORS)
    zigzag = modal.zigzag(spark.createDataFrame([(3000.0,)], "rpm double"), SECTORS, 900.0)
    return rounded(studies.zigzag_crossings(lines, zigzag, 3000.0), "cross_nd", "cross_hz")


@query(
    f"""with {_POINTS}, b as (select family, nd, max(freq_hz) as top, min(freq_hz) as low from z group by all), keep as (select family from b group by family having count(*) = count(case when nd <> 3 or family <> 2 then 1 end))
 select z.family, z.nd, z.freq_hz, z.whirl, b.top as upper, b.low as lower from z left join (select * from b where family in (select family from keep)) b using (family, nd)"""
)
def confidence_band(spark, d):
    """Bands of a family apply only if both bounds have as many points."""
    z = _points(spark, d).withColumnRenamed("nd", "at")
    b = z.groupBy("family", "at").agg(F.max("freq_hz").alias("top"), F.min("freq_hz").alias("low"))
    upper, lower = b.select("family", "at", F.col("top").alias("bound")), b.where("at <> 3 or family <> 2").select("family", "at", F.col("low").alias("bound"))
    return studies.with_band(z, upper, lower, ["family"]).withColumnRenamed("at", "nd")


@query(f"with {MODAL} select rpm, vanes, n, round(n * vanes * rpm / 60, 6) as line_hz from (select distinct rpm from modal where rpm > 0), (select unnest([7, 11])::int as vanes), (select unnest(range(1, 200))::int as n) where n * vanes * rpm / 60 <= 900")
def passing_lines(spark, d):
    """P31."""
    vanes = spark.createDataFrame([(7,), (11,)], "vanes int")
    return rounded(studies.passing_lines(views.modal(spark, d).select("rpm").distinct(), vanes, 900.0).where("line_hz <= 900"), "line_hz")


_MASS = f"{TRIPLETS}, mass as (select row, col, sum(val) as val from triplets group by all), e as (select vec_id, unnest(range(64)) as dof, unnest(embedding)::double as v from embeddings)"


def _dofs(spark, d):
    return views.shapes(spark, d).select("vec_id", F.posexplode("shape").alias("dof", "re")).withColumn("im", F.col("re") * 0.5)


@query(f"with {_MASS} select a.vec_id, round({SECTORS} * sum(1.25 * a.v * b.v * val), 4) as modal_mass from e a join mass on a.dof = row join e b on b.dof = col and b.vec_id = a.vec_id group by all")
def modal_mass(spark, d):
    """With a full matrix."""
    return rounded(studies.modal_mass(_dofs(spark, d), sparse.assemble(views.triplets(spark, d)), ["vec_id"], SECTORS), "modal_mass", digits=4)


@query(f"with {_MASS}, md as (select row, sum(val) as md from mass where col % 3 = 0 group by row) select vec_id, round(abs(sum(v * md)) * sqrt(1.25), 4) as gamma from e join md on row = dof group by vec_id")
def mass_factors(spark, d):
    """With a full matrix."""
    direction = spark.range(97).where("id % 3 = 0").select(F.col("id").cast("int").alias("dof"), F.lit(1.0).alias("val"))
    return rounded(studies.mass_factors(_dofs(spark, d), sparse.assemble(views.triplets(spark, d)), direction, ["vec_id"]), "gamma", digits=4)


@query(f"with {MODAL} select k, count(*) as modes, row_number() over (order by k)::int - 1 as place from modal group by k")
def harmonic_table(spark, d):
    """A23, T4, J14."""
    return studies.harmonic_table(views.modal(spark, d))


@query(f"with {MODAL}, f as (select k, case when mode_idx = 3 then 'nan'::double when mode_idx = 4 then -freq_hz else freq_hz end as freq_hz, mode_idx from modal) select k, count(*) filter (isnan(freq_hz)) as not_numbers, count(*) filter (not isnan(freq_hz) and freq_hz < 0) as negative, count(*) filter (mode_idx = 5) as no_norm from f group by k")
def suspicious_modes(spark, d):
    """F13."""
    m = views.modal(spark, d).withColumn("freq_hz", F.when(F.col("mode_idx") == 3, float("nan")).when(F.col("mode_idx") == 4, -F.col("freq_hz")).otherwise(F.col("freq_hz")))
    return studies.suspicious(m, F.when(F.col("mode_idx") == 5, 0.0).otherwise(1.0))


@query(
    f"""with {TRUTH}, s as (select nd, coalesce(avg(rel), 0) as a, coalesce(max(rel), 0) as b, coalesce(stddev_pop(rel), 0) as c, count(rel) as n from rel group by nd),
 l as (select string_agg(printf('  ND %2d: mean=%.4f%%  max=%.4f%%  std=%.4f%%  (%d modes)', nd, a, b, c, n), chr(10) order by nd) as body, count(*) as n from s), w as (select nd, j, greatest(coalesce(rel, -1), 0) as r from rel order by coalesce(rel, -1) desc, nd, j limit 1), t as (select coalesce(avg(rel), 0) as a, coalesce(max(rel), 0) as b from rel)
 select printf('Frequency Diagnostic Summary (%d NDs x 11 modes)', l.n) || chr(10) || printf('  Mean relative error:  %.4f%%', t.a) || chr(10) || printf('  Max  relative error:  %.4f%%', t.b) || chr(10) || printf('  Worst mode: ND=%d, mode=%d (%.4f%%)', w.nd, w.j, w.r) || chr(10) || body as summary from l, w, t"""
)
def diagnostic_text(spark, d):
    """P32."""
    rel = response.errors(*views.truth(spark, d))
    return studies.diagnostic_text(response.error_stats(rel), rel, 11)


@query(f"with {NODES} select node_id as left_id, node_id + 1000000 as right_id, 0.0::double as distance from nodes")
def sector_sides(spark, d):
    """Points and their turned copies as one surface."""
    n, a = views.nodes(spark, d), 2 * math.pi / SECTORS
    turned = n.select((F.col("node_id") + 1000000).alias("node_id"), (F.col("x") * math.cos(a) - F.col("y") * math.sin(a)).alias("x"), (F.col("x") * math.sin(a) + F.col("y") * math.cos(a)).alias("y"), "z")
    return rounded(detect.sector_sides(n.unionByName(turned), SECTORS, 1e-3), "distance")


@query("with c as (select s_suppkey as s, 1 + (s_suppkey % 37) / 10.0::double as x, (s_suppkey % 53) / 10.0::double as y, s_suppkey / 100.0::double as z from supplier) select s as left_surface, s + 5000 as right_surface, 0.01::double as distance from c")
def surface_pairs(spark, d):
    """Centres of surfaces against turned ones a little higher."""
    k, a = F.col("s_suppkey"), 2 * math.pi / SECTORS
    left = views.table(spark, d, "supplier").select(k.alias("surface_id"), (1 + k % 37 / 10.0).alias("x"), (k % 53 / 10.0).alias("y"), (k / 100.0).alias("z"))
    right = left.select((F.col("surface_id") + 5000).alias("surface_id"), (F.col("x") * math.cos(a) - F.col("y") * math.sin(a)).alias("x"), (F.col("x") * math.sin(a) + F.col("y") * math.cos(a)).alias("y"), (F.col("z") + 0.01).alias("z"))
    return rounded(detect.surface_pairs(left, right, SECTORS, 0.02), "distance")


@query(
    """with s as (select distinct l_orderkey as surface_id, l_partkey as node_id from lineitem), f as (select surface_id, avg((node_id % 3 = 0)::int) as l, avg((node_id % 3 = 1)::int) as r from s group by all)
 select surface_id, case when l > 0.5 then 'left' else 'right' end as side from f where l > 0.5 or r > 0.5"""
)
def surface_sides(spark, d):
    """Orders as surfaces of parts."""
    s = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("surface_id"), F.col("l_partkey").alias("node_id"))
    n = s.select("node_id").distinct()
    return detect.surface_sides(s, n.where("node_id % 3 = 0"), n.where("node_id % 3 = 1"))


_WEDGES = """s as (select s_suppkey as id, 1 + (s_suppkey % 7) / 10.0::double as x, (s_suppkey % 11) / 10.0::double as y, (s_suppkey % 5) / 5.0::double as nz from supplier), n as (select *, -y / sqrt(x * x + y * y) * sqrt(1 - nz * nz) as nx, x / sqrt(x * x + y * y) * sqrt(1 - nz * nz) as ny from s)"""


@query(
    f"""with {_WEDGES}, t as (select l_suppkey as id, atan2(y, x) + (l_quantity - 25) * 0.0001::double * (l_suppkey % 13) as theta, atan2(y, x) as centre from lineitem join s on id = l_suppkey),
 w as (select id from t group by id having count(*) >= 4 and quantile_cont(theta - centre, 0.9) - quantile_cont(theta - centre, 0.1) > 0.1 * {TWO_PI} / {SECTORS})
 select id as surface_id from n where abs(nz) <= 0.5 and abs(ny * x - nx * y) / sqrt(x * x + y * y) > 0.5 and id not in (select id from w)"""
)
def wedge_surfaces(spark, d):
    """suppliers as surfaces, their lines as points on edges."""
    k = F.col("s_suppkey")
    s = views.table(spark, d, "supplier").select(k.alias("surface_id"), (1 + k % 7 / 10.0).alias("x"), (k % 11 / 10.0).alias("y"), F.lit(0.0).alias("z"), (k % 5 / 5.0).alias("nz"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    side = F.sqrt(1 - F.col("nz") * F.col("nz"))
    s = s.withColumn("nx", -F.col("y") / r * side).withColumn("ny", F.col("x") / r * side)
    points = views.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("surface_id")).select("surface_id", (F.atan2("y", "x") + (F.col("l_quantity") - 25) * 0.0001 * (F.col("l_suppkey") % 13)).alias("theta"))
    return detect.wedge_surfaces(s, points, SECTORS).select("surface_id")


@query(
    f"""with {NODES}, b as (select x as x0, x + 0.05 as x1, y as y0, y + 0.07 as y1, z as z0, z + 0.1 as z1 from nodes), r as (select *, sqrt(x0 * x0 + y0 * y0) as a, sqrt(x1 * x1 + y1 * y1) as o from b)
 select round(min(x0), 6) as min_x, round(max(x1), 6) as max_x, round(min(y0), 6) as min_y, round(max(y1), 6) as max_y, round(min(z0), 6) as min_z, round(max(z1), 6) as max_z, round(min(a), 6) as inner_r, round(max(o), 6) as outer_r, round(max(z1) - min(z0), 6) as axial_length,
 round(greatest(max(x1) - min(x0), max(y1) - min(y0), max(z1) - min(z0)) / 20, 6) as mesh_size from r"""
)
def box_summary(spark, d):
    """Parts as boxes."""
    b = views.nodes(spark, d).select(F.col("x").alias("x0"), (F.col("x") + 0.05).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 0.07).alias("y1"), F.col("z").alias("z0"), (F.col("z") + 0.1).alias("z1"))
    out = detect.box_summary(b)
    return rounded(out, *out.columns)


@query(f"with {NODES}, c as (select node_id, x as r, z, (select avg(x) from nodes) as mr, (select avg(z) from nodes) as mz from nodes) select node_id as point_id, row_number() over (order by atan2(round(z - mz, 9), round(r - mr, 9)), node_id)::int as place from c")
def outline_order(spark, d):
    """By the angle about the centre."""
    p = views.nodes(spark, d).select(F.col("node_id").alias("point_id"), F.col("x").alias("r"), "z")
    mean = p.agg(F.avg("r").alias("mr"), F.avg("z").alias("mz"))
    shifted = p.crossJoin(F.broadcast(mean)).select("point_id", F.round(F.col("r") - F.col("mr"), 9).alias("r"), F.round(F.col("z") - F.col("mz"), 9).alias("z"))
    return detect.around_centre(shifted, centred=True).select("point_id", "place")


@query("select p_partkey, case when p_size % 10 = 3 then '' else 'T=' || (290 + p_size % 10)::int || 'K' end as label, round(p_size * (1 + (case p_size % 3 when 0 then 0.6526 when 1 then 0.3910 else 0.2737 end)::double * 0.125::double * 30), 6) as mass, round(800 * pow(p_size * 10.0::double, 4.0::double / 3) + 2 * p_size * 10 * (least(21, p_size * 10) + 1) * 16, 3) as bytes from part")
def condition_notes(spark, d):
    """P28, P12, P27."""
    n, c = (F.col("p_size") * 10).cast("int"), F.col("p_size")
    at = F.when(c % 10 == 3, 293.15).otherwise(290.0 + c % 10)
    mass = physics.corrected_mass(c.cast("double"), c % 3, F.lit(1000.0), F.lit(8000.0), F.lit(0.3), F.lit(0.01))
    return views.table(spark, d, "part").select("p_partkey", physics.condition_label(at).alias("label"), F.round(mass, 6).alias("mass"), F.round(physics.harmonic_bytes(n, 5), 3).alias("bytes"))


@query(
    f"""with {NODES}, u as (select node_id, x as a, -y as b, y as c, z as e, z as f, x as g from nodes)
 select node_id, round(sqrt(a * a + b * b + c * c + e * e + f * f + g * g), 6) as magnitude, a as x, round(sqrt(a * a + c * c + f * f), 6) as re, round(sqrt(b * b + e * e + g * g), 6) as im from u"""
)
def mode_component(spark, d):
    """P23."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    parts = {"x": (x, -y), "y": (y, z), "z": (z, x)}
    show = [physics.component(n, parts).alias(a) for n, a in (("magnitude", "magnitude"), ("x", "x"), ("real", "re"), ("imag", "im"))]
    return rounded(views.nodes(spark, d).select("node_id", *show), "magnitude", "re", "im")


@query(f"with {NODES} select node_id, round(z * cos(0.3) - x * sin(0.3), 6) as x, round(z * sin(0.3) + x * cos(0.3), 6) as y, y as z from nodes")
def axis_aligned(spark, d):
    """Y to z, then a turn about z."""
    n = views.nodes(spark, d).select("node_id", *physics.aligned("y"))
    m = physics.rotation("z", 0.3)
    turned = [sum((F.col(c) * m[i][j] for j, c in enumerate("xyz")), F.lit(0.0)).alias(to) for i, to in enumerate("xyz")]
    return rounded(n.select("node_id", *turned[:2], "z"), "x", "y")
