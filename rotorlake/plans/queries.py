"""Registered queries: operators over views of the driver's tables, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import fem, mesh, modal, response, sparse
from ..sources import results
from . import views
from .views import ELEMENTS, MODAL, NODES, SECTORS, TRIANGLES, TRIPLETS, TRUTH

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TWO_PI = repr(physics.TWO_PI)


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def numbers(spark, name: str, *values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} int")


SPLIT = f"""{MODAL}, labelled as (select *, max(abs(whirl)) over (partition by rpm, k) > 0 as has, k * abs(rpm) / 60 as shift from modal),
stationary as (
 select rpm, k, mode_idx, abs(freq_hz + whirl * shift) as freq_hz, whirl from labelled where k > 0 and rpm <> 0 and has
 union all select rpm, k, mode_idx, abs(freq_hz - shift), -1 from labelled where k > 0 and rpm <> 0 and not has and k < {SECTORS // 2}
 union all select rpm, k, mode_idx, freq_hz + shift, 1 from labelled where k > 0 and rpm <> 0 and not has and k < {SECTORS // 2}
 union all select rpm, k, mode_idx, freq_hz, 0 from labelled where not (k > 0 and rpm <> 0 and (has or k < {SECTORS // 2})))"""


@query(f"with {SPLIT} select rpm, k, mode_idx, round(freq_hz, 6) as freq_hz, whirl from stationary")
def stationary_split(spark, d):
    """U1."""
    return rounded(modal.stationary_split(views.modal(spark, d), SECTORS), "freq_hz")


@query(
    f"with {MODAL}, m as (select * from modal where k between 1 and 11 and rpm > 0) select rpm, k, mode_idx, unnest([round(abs(freq_hz - k * rpm / 60), 6), round(freq_hz + k * rpm / 60, 6)]) as freq_hz, unnest([-1, 1])::int as whirl from m"
)
def kinematic_split(spark, d):
    """U1, the branch without whirl labels."""
    rows = views.modal(spark, d).where("k between 1 and 11 and rpm > 0").withColumn("whirl", F.lit(0))
    return rounded(modal.stationary_split(rows, SECTORS, F.lit(False)), "freq_hz")


@query(f"with {SPLIT} select rpm, k, mode_idx, round(freq_hz, 6) as freq_hz, whirl, row_number() over (partition by rpm, k order by freq_hz, whirl, mode_idx)::int as family from stationary")
def campbell_long(spark, d):
    """U1, T5, W8."""
    return rounded(modal.campbell(views.modal(spark, d), SECTORS), "freq_hz")


@query(f"with {MODAL} select *, row_number() over (partition by rpm, k order by freq_hz, mode_idx)::int as rank from modal where freq_hz > 15 qualify rank <= 3")
def rigid_body_topk(spark, d):
    """F8, T2."""
    return modal.lowest(views.modal(spark, d), 3, 15.0)


@query(
    f"with {MODAL}, o as (select rpm, k, mode_idx, whirl * freq_hz as omega from modal where abs(whirl * freq_hz) >= 1e-6) select *, sign(omega)::int as sign, row_number() over (partition by rpm, k, sign(omega) order by abs(omega), mode_idx)::int as rank from o qualify rank <= 2"
)
def qep_topk_by_sign(spark, d):
    """T3."""
    return modal.by_sign(views.modal(spark, d).select("rpm", "k", "mode_idx", (F.col("whirl") * F.col("freq_hz")).alias("omega")), 2)


@query(
    f"with {MODAL}, e as (select rpm, k, mode_idx, freq_hz, unnest(case when k > 0 and k < 12 then [1, -1] else [0] end)::int as whirl from modal) select *, row_number() over (partition by rpm, k order by freq_hz, mode_idx, whirl desc)::int as expanded_idx from e qualify expanded_idx <= 7"
)
def degenerate_expand(spark, d):
    """U2."""
    return modal.expand_degenerate(views.modal(spark, d), SECTORS, 7)


@query(f"with {MODAL}, f as (select *, least(k, 24 - k)::int as nd from modal) select *, (case when nd > 0 and nd < 12 then mode_idx // 2 else mode_idx end)::int as family from f")
def zzenf_families(spark, d):
    """U8, W12, F17."""
    return modal.families(views.modal(spark, d), SECTORS)


@query(
    f"with {MODAL}, f as (select *, least(k, 24 - k)::int as nd from modal), g as (select *, (case when nd > 0 and nd < 12 then mode_idx // 2 else mode_idx end)::int as family from f) select * from g qualify row_number() over (partition by family, nd order by freq_hz, mode_idx, rpm) = 1"
)
def dedup_nd(spark, d):
    """W7."""
    return modal.first_per_diameter(modal.families(views.modal(spark, d), SECTORS))


@query(f"with {MODAL}, f as (select *, least(k, 24 - k)::int as nd from modal), g as (select *, (case when nd > 0 and nd < 12 then mode_idx // 2 else mode_idx end)::int as family from f) select family, min(freq_hz) as min_freq from g group by all")
def family_order(spark, d):
    """A24."""
    return modal.family_order(modal.families(views.modal(spark, d), SECTORS))


@query(f"with {MODAL} select k, mode_idx, (case when count(*) filter (whirl = 1) >= count(*) filter (whirl = -1) then 1 else -1 end)::int as dominant from modal group by all")
def dominant_whirl(spark, d):
    """A27."""
    return modal.dominant_whirl(views.modal(spark, d))


@query(
    f"""with {MODAL}, p as (select k, mode_idx, rpm, freq_hz, lead(rpm) over w as rpm2, lead(freq_hz) over w as freq2 from modal window w as (partition by k, mode_idx order by rpm)),
 c as (select *, freq_hz - eo * rpm / 60 as d1, freq2 - eo * rpm2 / 60 as d2 from p, (select unnest(range(1, 13))::int as eo) where rpm2 is not null),
 x as (select k, mode_idx, eo, rpm + abs(d1) / (abs(d1) + abs(d2)) * (rpm2 - rpm) as a from c where d1 * d2 < 0) select k, mode_idx, eo, round(a, 6) as cross_rpm, round(eo * a / 60, 6) as cross_hz from x"""
)
def eo_crossings(spark, d):
    """W2."""
    return rounded(modal.crossings(views.modal(spark, d), numbers(spark, "eo", *range(1, 13))), "cross_rpm", "cross_hz")


@query(f"with {MODAL}, r as (select distinct rpm from modal) select rpm, eo, round(eo * rpm / 60, 6) as line_hz from r, (select unnest(range(1, 25))::int as eo) where eo * rpm / 60 <= 900")
def engine_order_lines(spark, d):
    """P31."""
    return rounded(modal.order_lines(views.modal(spark, d).select("rpm").distinct(), numbers(spark, "eo", *range(1, 25)), 900.0), "line_hz")


@query(
    f"with {MODAL}, r as (select distinct rpm from modal where rpm > 0), e as (select rpm, unnest(range(0, floor(900 / (rpm / 60))::int + 2))::int as e from r) select rpm, e, least(e % 24, 24 - e % 24)::int as nd, round(e * rpm / 60, 6) as line_hz from e"
)
def zigzag(spark, d):
    """W6."""
    return rounded(modal.zigzag(views.modal(spark, d).select("rpm").distinct(), SECTORS, 900.0), "line_hz")


@query(
    """with v as (select unnest([7, 11, 18, 36])::int as vanes), n as (select unnest(range(1, 6))::int as n), m as (select unnest(range(-50, 51)) as m), o as (select vanes, n, abs(n * vanes - m * 24) as o from v, n, m)
 select distinct vanes, n, least(o % 24, 24 - o % 24)::int as nd from o"""
)
def tyler_sofrin(spark, d):
    """J9."""
    return modal.tyler_sofrin([7, 11, 18, 36], 5, SECTORS, spark)


@query(f"with {MODAL} select modal.*, eo from modal, (select unnest(range(0, 31))::int as eo) where eo % 24 = k % 24 or eo % 24 = (24 - k % 24) % 24")
def eo_aliasing(spark, d):
    """J8, F9."""
    return modal.excited(views.modal(spark, d), numbers(spark, "eo", *range(0, 31)), SECTORS)


@query(
    """with s as (select vec_id, label as k, vec_id // 64 as part, embedding::double[] as v from embeddings) select a.vec_id as i, b.vec_id as j,
 round(pow(list_dot_product(a.v, b.v), 2) / greatest(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v), 1e-300), 6) as mac from s a join s b on a.k = b.k and b.part = a.part + 1"""
)
def mac_pairs(spark, d):
    """Shapes in result sets of 64, each set's modes against those of the next one, harmonic by harmonic."""
    s = views.shapes(spark, d).withColumn("part", F.floor(F.col("vec_id") / 64))
    a = s.select(F.col("vec_id").alias("i"), "k", (F.col("part") + 1).alias("part"), F.col("shape").alias("a"))
    b = s.select(F.col("vec_id").alias("j"), "k", "part", F.col("shape").alias("b"))
    return a.join(b, ["k", "part"]).select("i", "j", F.round(modal.mac(F.col("a"), F.col("b")), 6).alias("mac"))


@query(
    """with s as (select vec_id, label as k, embedding::double[] as v from embeddings), m as (select k, vec_id, lead(vec_id) over w as next_id, v, lead(v) over w as v2 from s window w as (partition by k order by vec_id))
 select k, vec_id, next_id, round(pow(list_dot_product(v, v2), 2) / greatest(list_dot_product(v, v) * list_dot_product(v2, v2), 1e-300), 6) as mac from m where next_id is not null"""
)
def auto_mac(spark, d):
    """Each shape against the next of its harmonic."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("vec_id")
    s = views.shapes(spark, d).withColumn("next_id", F.lead("vec_id").over(w)).withColumn("b", F.lead("shape").over(w)).where("next_id is not null")
    return s.select("k", "vec_id", "next_id", F.round(modal.mac(F.col("shape"), F.col("b")), 6).alias("mac"))


@query(
    """with p as (select p_partkey, (1 + p_size) * 1e9 as e, 0.2 + (p_size % 20) / 100.0::double as nu, 2000.0::double + p_size * 10 as rho, p_retailprice as t from part)
 select p_partkey, round((e - 1e5 * (t - 293.15)) / 1e9, 9) as e_gpa, round((e - 1e5 * (t - 293.15)) / ((1 + nu) * (1 - 2 * nu)) * (1 - nu) / 1e9, 9) as d11_gpa,
 round((e - 1e5 * (t - 293.15)) / ((1 + nu) * (1 - 2 * nu)) * nu / 1e9, 9) as d12_gpa, round((e - 1e5 * (t - 293.15)) / ((1 + nu) * (1 - 2 * nu)) * (1 - 2 * nu) / 2 / 1e9, 9) as d44_gpa, e > 0 and nu > 0 and nu < 0.5 and rho > 0 as valid from p"""
)
def materials(spark, d):
    """P1, P2, P3."""
    p = views.table(spark, d, "part").select("p_partkey", ((1 + F.col("p_size")) * 1e9).alias("e"), (0.2 + F.col("p_size") % 20 / 100.0).alias("nu"), (2000.0 + F.col("p_size") * 10).alias("rho"), F.col("p_retailprice").alias("t"))
    p = p.withColumn("scaled", physics.scaled_modulus(F.col("e"), F.lit(-1e5), F.col("t"), F.lit(293.15)))
    law = physics.constitutive(F.col("scaled"), F.col("nu"))
    r = lambda c: F.round(c / 1e9, 9)
    return p.select("p_partkey", r(F.col("scaled")).alias("e_gpa"), r(law[0][0]).alias("d11_gpa"), r(law[0][1]).alias("d12_gpa"), r(law[3][3]).alias("d44_gpa"), physics.valid_material(F.col("e"), F.col("nu"), F.col("rho")).alias("valid"))


@query(
    f"""with {MODAL} select rpm, k, mode_idx, round(case mode_idx % 3 when 0 then 0.0 when 1 then ([0.01, 0.02, 0.03]::double[])[least(mode_idx + 1, 3)] else 10.0 / (2 * freq_hz * {TWO_PI}) + 1e-5 * freq_hz * {TWO_PI} / 2 end, 9) as zeta from modal"""
)
def damping(spark, d):
    """P10."""
    kind = F.element_at(F.array(F.lit("NONE"), F.lit("MODAL"), F.lit("RAYLEIGH")), F.col("mode_idx") % 3 + 1)
    z = physics.damping(kind, F.array(F.lit(0.01), F.lit(0.02), F.lit(0.03)), F.lit(10.0), F.lit(1e-5), F.col("mode_idx"), F.col("freq_hz") * physics.TWO_PI)
    return views.modal(spark, d).select("rpm", "k", "mode_idx", F.round(z, 9).alias("zeta"))


@query(
    f"""with {MODAL}, g as (select *, case when k <= 10 then ([0.6526, 0.3910, 0.2737, 0.2078, 0.1660, 0.1372, 0.1163, 0.1003, 0.0878, 0.0777, 0.0695]::double[])[k + 1] else 0.65::double / pow(k + 0.05::double, 0.85::double) end as gamma from modal),
 q as (select *, 1 / sqrt(1 + gamma * (1000.0::double / 7800) * (0.3::double / 0.01)) as ratio from g) select rpm, k, mode_idx, round(ratio, 6) as ratio, round(freq_hz * ratio, 6) as wet_hz from q"""
)
def kwak_ratio(spark, d):
    """P11, P13."""
    ratio = physics.added_mass_ratio(F.col("k"), F.lit(1000.0), F.lit(7800.0), F.lit(0.3), F.lit(0.01))
    return views.modal(spark, d).select("rpm", "k", "mode_idx", F.round(ratio, 6).alias("ratio"), F.round(physics.corrected(F.col("freq_hz"), ratio), 6).alias("wet_hz"))


@query(f"with {MODAL} select rpm, k, mode_idx, round(case when k > 0 then {TWO_PI} * freq_hz * 0.3 / k else 0 end, 6) as velocity from modal")
def wave_velocity(spark, d):
    """P8."""
    return views.modal(spark, d).select("rpm", "k", "mode_idx", F.round(physics.wave_velocity(F.col("freq_hz"), F.col("k"), 0.3), 6).alias("velocity"))


_FRF = f"""{MODAL}, s as (select rpm, k, mode_idx, freq_hz, i::int as step, 5.0::double + (500.0::double - 5.0) * i / 19 as f_hz from modal, (select unnest(range(0, 20)) as i)),
 q as (select *, {TWO_PI} * freq_hz as wr, {TWO_PI} * f_hz as w, 3.0::double as q_re, -2.0::double as q_im from s),
 h as (select *, wr * wr - w * w as a, 2 * 0.015::double * wr * w as b from q),
 r as (select rpm, k, mode_idx, step, f_hz, (q_re * a + q_im * b) / (a * a + b * b) as h_re, (q_im * a - q_re * b) / (a * a + b * b) as h_im from h)"""


def _frf(spark, d):
    modes = views.modal(spark, d).withColumn("q_re", F.lit(3.0)).withColumn("q_im", F.lit(-2.0))
    return response.frf(modes, 20, F.lit(0.015), F.lit(5.0), F.lit(500.0))


@query(f"with {_FRF} select rpm, k, mode_idx, step, round(f_hz, 6) as f_hz, round(h_re * 1e6, 6) as h_re, round(h_im * 1e6, 6) as h_im from r")
def frf_sweep(spark, d):
    """P14, U10."""
    return _frf(spark, d).select("rpm", "k", "mode_idx", "step", F.round("f_hz", 6).alias("f_hz"), F.round(F.col("h_re") * 1e6, 6).alias("h_re"), F.round(F.col("h_im") * 1e6, 6).alias("h_im"))


@query(f"with {_FRF} select rpm, k, mode_idx, round(max(sqrt(h_re * h_re + h_im * h_im)) * 1e6, 6) as peak, round(arg_max(f_hz, sqrt(h_re * h_re + h_im * h_im)), 6) as peak_hz from r group by all")
def frf_peak(spark, d):
    """A17."""
    out = response.peak(_frf(spark, d), ["rpm", "k", "mode_idx"])
    return out.select("rpm", "k", "mode_idx", F.round(F.col("peak") * 1e6, 6).alias("peak"), F.round("peak_hz", 6).alias("peak_hz"))


@query(f"with {MODAL} select round(min(freq_hz) * 0.5, 6) as low, round(max(freq_hz) * 1.5, 6) as high from modal")
def sweep_range(spark, d):
    """A18."""
    return rounded(response.auto_range(views.modal(spark, d)), "low", "high")


@query(
    """with s as (select vec_id, embedding::double[] as v, list_transform(range(64), lambda i: 1.0::double + (i % 7) / 10.0::double) as m, list_transform(range(64), lambda i: case when i % 3 = 0 then 1.0::double else 0.0::double end) as dir from embeddings),
 w as (select vec_id, v, dir, list_transform(range(64), lambda i: v[i + 1] * m[i + 1]) as mv from s), g as (select vec_id, abs(list_dot_product(mv, dir)) as gamma, abs(list_dot_product(mv, v)) as gen from w)
 select vec_id, round(gamma, 6) as gamma, round(gen, 6) as gen_mass, round(case when gen > 1e-30 then gamma * gamma / gen else 0 end, 6) as eff_mass from g"""
)
def participation(spark, d):
    """A9, A10, A5 (diagonal mass)."""
    mass = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1.0 + i % 7 / 10.0)
    direction = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 3 == 0, 1.0).otherwise(0.0))
    return rounded(response.participation(views.shapes(spark, d), mass, direction).select("vec_id", "gamma", "gen_mass", "eff_mass"), "gamma", "gen_mass", "eff_mass")


@query(
    """with e as (select vec_id, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings), p as (select vec_id, i // 2 as n, max(case when i % 2 = 0 then v end) as re, max(case when i % 2 = 1 then v end) as im from e group by all)
 select vec_id, round(sum(re * cos(n) - im * sin(n)), 6) as q_re, round(sum(re * sin(n) + im * cos(n)), 6) as q_im from p group by vec_id"""
)
def modal_forces(spark, d):
    """32 complex entries against a travelling load."""
    parts = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("shape", 2 * i).alias("re"), F.get("shape", 2 * i + 1).alias("im")))).alias("node_id", "p")
    s = views.shapes(spark, d).select("vec_id", parts).select("vec_id", "node_id", F.lit(2).alias("d"), "p.re", "p.im")
    force = spark.range(32).select(F.col("id").cast("int").alias("node_id"), F.lit(2).alias("d"), F.cos(F.col("id").cast("double")).alias("re"), F.sin(F.col("id").cast("double")).alias("im"))
    return rounded(response.modal_forces(s, force, ["vec_id"]), "q_re", "q_im")


@query(
    f"with {NODES} select node_id, 2::int as d, round(2.5::double * cos(3 * atan2(y, x)), 6) as re, round(2.5::double * sin(3 * atan2(y, x)), 6) as im from nodes"
)
def excitation(spark, d):
    """P15."""
    return rounded(response.excitation(views.nodes(spark, d), F.lit(3), 2.5), "re", "im")


@query(
    """with e as (select vec_id, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings), p as (select vec_id, i // 2 as n, max(case when i % 2 = 0 then v end) as re, max(case when i % 2 = 1 then v end) as im from e group by all),
 a as (select vec_id, re * re + im * im as a2 from p) select (vec_id % 10)::bigint as pattern, vec_id as mode, round(max(sqrt(a2)) * sqrt(32), 6) as magnification, round(case when sum(a2) > 1e-30 then 32 * sum(a2 * a2) / (sum(a2) * sum(a2)) else 1 end, 6) as ipr from a group by vec_id"""
)
def localisation(spark, d):
    """A11."""
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("shape", 2 * i).alias("re"), F.get("shape", 2 * i + 1).alias("im")))).alias("p")
    s = views.shapes(spark, d).select((F.col("vec_id") % 10).alias("pattern"), F.col("vec_id").alias("mode"), parts).select("pattern", "mode", "p.re", "p.im")
    return rounded(response.localisation(s, 32), "magnification", "ipr")


@query(f"with {TRIPLETS} select row, col, round(sum(val), 4) as val from triplets group by all")
def assemble_coo(spark, d):
    """A1, A2."""
    return rounded(sparse.assemble(views.triplets(spark, d)), "val", digits=4)


@query(f"with {TRIPLETS}, s as (select row, col, sum(val) as val from triplets group by all) select row, col, round(val, 4) as val from s where abs(val) > 0.3 * (select max(abs(val)) from s)")
def sparse_prune(spark, d):
    """F10."""
    return rounded(sparse.pruned(sparse.assemble(views.triplets(spark, d)), 0.3), "val", digits=4)


_K = f"{TRIPLETS}, k as (select row, col, sum(val) as val from triplets group by all), t as (select i::int as row, (i % 20)::int as col, 1.0::double + i % 3 as val from (select unnest(range(97)) as i))"


def _t(spark):
    return spark.range(97).select(F.col("id").cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), (1.0 + F.col("id") % 3).alias("val"))


@query(f"with {_K} select a.col as row, b.col as col, round(sum(a.val * k.val * b.val), 4) as val from k join t a on k.row = a.row join t b on k.col = b.row group by all")
def spmm_triple(spark, d):
    """J17."""
    return rounded(sparse.triple(_t(spark), sparse.assemble(views.triplets(spark, d))), "val", digits=4)


@query(f"with {_K}, f as (select i as dof, row_number() over (order by i) - 1 as idx from (select unnest(range(97)) as i) where i % 7 <> 0) select a.idx as row, b.idx as col, round(val, 4) as val from k join f a on k.row = a.dof join f b on k.col = b.dof")
def eliminate_dofs(spark, d):
    """J5."""
    dofs = spark.range(97).select(F.col("id").alias("dof"))
    free = sparse.free_map(dofs, dofs.where("dof % 7 = 0"))
    return rounded(sparse.eliminate(sparse.assemble(views.triplets(spark, d)), free), "val", digits=4)


@query("with e as (select vec_id as mode, unnest(range(64)) as dof, unnest(embedding)::double as v from embeddings) select mode, dof, case when dof % 7 = 0 then 0 else round(v, 6) end as val from e")
def expand_modes(spark, d):
    """Shapes with fixed degrees of freedom back at full size."""
    dofs = spark.range(64).select(F.col("id").alias("dof"))
    free = sparse.free_map(dofs, dofs.where("dof % 7 = 0"))
    vectors = views.shapes(spark, d).select(F.col("vec_id").alias("mode"), F.posexplode("shape").alias("dof", "val")).join(free, "dof").select("mode", "idx", "val")
    return rounded(sparse.expand(vectors, free, dofs), "val")


@query(f"with {_K} select row, col, round(sum(val), 4) as val from (select row, col, val from k union all select row, col, -2 * val from t union all select col, row, 0.5 * val from k) group by all")
def matrix_combine(spark, d):
    """U13."""
    k = sparse.assemble(views.triplets(spark, d))
    return rounded(sparse.combine([(1.0, k), (-2.0, _t(spark)), (0.5, sparse.transpose(k))]), "val", digits=4)


@query(
    f"""with {_K}, kp as (select * from k where col < 20) select row, col, round(sum(re), 4) as re, round(sum(im), 4) as im from (select row, col, val as re, 0 as im from k union all select row, col, val * cos(0.75::double), val * sin(0.75::double) from kp
 union all select col, row, val * cos(0.75::double), -val * sin(0.75::double) from kp) group by all"""
)
def phase_combine(spark, d):
    """K + P Kp + conj(P) Kp'."""
    k = sparse.assemble(views.triplets(spark, d))
    return rounded(sparse.phased(k, k.where("col < 20"), 0.75), "re", "im", digits=4)


@query(f"with {_K} select row, col, round(sum(val), 4) as val from (select row, col, 0.1 * val as val from k union all select row, col + 97, val from k union all select row + 97, col, val from k) group by all")
def lancaster_block(spark, d):
    """P26."""
    k = sparse.assemble(views.triplets(spark, d))
    left, _ = sparse.lancaster(k, k.withColumn("val", 0.1 * F.col("val")), k, 97)
    return rounded(sparse.assemble(left), "val", digits=4)


@query(
    f"with {_K}, m as (select row, col, 0.01 * val as val from k) select round(sqrt((select sum(val * val) from k)) / sqrt((select sum(val * val) from m)), 6) as shift"
)
def qep_shift(spark, d):
    """P34."""
    k = sparse.assemble(views.triplets(spark, d))
    return rounded(sparse.shift_of(k, k.withColumn("val", 0.01 * F.col("val"))), "shift")


@query(f"with {_K}, b as (select unnest(range(10))::int as dof), g as (select row as dof, val from k where row = col and row >= 10 order by val desc, row limit 15) select dof from b union all select dof from g")
def master_dofs(spark, d):
    """A15."""
    k = sparse.assemble(views.triplets(spark, d))
    return sparse.masters(k.where("row = col").select(F.col("row").alias("dof"), "val"), spark.range(10).select(F.col("id").cast("int").alias("dof")), 25)


@query(f"with {ELEMENTS} select elem_id, face_idx from boundary")
def boundary_faces(spark, d):
    """A3."""
    return mesh.boundary_faces(views.elements(spark, d)).select("elem_id", "face_idx")


@query(f"with {TRIANGLES} select e[1] as a, e[2] as b from triangle group by all having count(*) = 1")
def boundary_edges(spark, d):
    """Of a strip of triangles."""
    return mesh.boundary_edges(views.triangles(spark, d))


@query(f"with {TRIANGLES} select a.elem_id, a.face_idx, count(*) as neighbours from triangle a join triangle b on a.e = b.e and a.elem_id <> b.elem_id group by all")
def face_neighbours(spark, d):
    """J21."""
    return mesh.face_neighbours(views.triangles(spark, d)).groupBy("face.elem_id", "face.face_idx").agg(F.count("*").alias("neighbours"))


@query(
    f"with {NODES} select node_id, x, y, z, round((x - 1) * 0.6::double + (y - 1) * 0.8::double, 6) + 0.0::double as distance from nodes where (x - 1) * 0.6 + (y - 1) * 0.8 >= -0.0012345"
)
def plane_select(spark, d):
    """F1."""
    return rounded(mesh.on_plane_side(views.nodes(spark, d), (1.0, 1.0, 0.0), (3.0, 4.0, 0.0), 0.0012345), "distance")


@query(f"with {NODES} select node_id + 100000 * s as node_id, s as sector, round(x * cos(s * {TWO_PI} / 6) - y * sin(s * {TWO_PI} / 6), 6) as x, round(x * sin(s * {TWO_PI} / 6) + y * cos(s * {TWO_PI} / 6), 6) as y, z from nodes, (select unnest(range(6))::int as s)")
def annulus_replicate(spark, d):
    """U5."""
    return rounded(mesh.replicate(views.nodes(spark, d), 6, 100000), "x", "y")


@query(f"with {NODES} select node_id as left_id, node_id + 1000000 as right_id, 0.0::double as distance from nodes")
def node_match(spark, d):
    """Points against their copies in the next sector, shuffled ids and all."""
    left = views.nodes(spark, d)
    a = 2 * math.pi / SECTORS
    right = left.select((F.col("node_id") + 1000000).alias("node_id"), (F.col("x") * math.cos(a) - F.col("y") * math.sin(a)).alias("x"), (F.col("x") * math.sin(a) + F.col("y") * math.cos(a)).alias("y"), "z")
    return rounded(mesh.match_boundaries(left, right, SECTORS), "distance")


@query(
    f"""with {NODES}, s as (select node_id, node_id % 4 = 0 as f, node_id % 5 = 0 as l, node_id % 6 = 0 as r, node_id % 7 = 0 as h from nodes)
 select node_id, case when f then 'free_boundary' when l then 'left_boundary' when r then 'right_boundary' when h then 'hub_constraint' else 'interior' end as class from s"""
)
def node_flags(spark, d):
    """J16."""
    n = views.nodes(spark, d)
    return mesh.node_flags(n, _sets(n))


def _sets(n: DataFrame) -> DataFrame:
    rules = {"free_boundary": 4, "left_boundary": 5, "right_boundary": 6, "hub_constraint": 7}
    return n.select("node_id", F.explode(F.array_compact(F.array(*[F.when(F.col("node_id") % m == 0, F.lit(s)) for s, m in rules.items()]))).alias("set_name"))


@query(f"with {NODES} select node_id from nodes where node_id % 5 <> 0 and node_id % 6 <> 0")
def free_boundary(spark, d):
    """U3, U4."""
    n = views.nodes(spark, d)
    return mesh.free_boundary(n, n.where("node_id % 5 = 0"), n.where("node_id % 6 = 0"))


@query(
    f"""with {NODES} select round(min(x), 6) as min_x, round(max(x), 6) as max_x, round(min(y), 6) as min_y, round(max(y), 6) as max_y, round(min(z), 6) as min_z, round(max(z), 6) as max_z, round(min(sqrt(x * x + y * y)), 6) as min_r,
 round(max(sqrt(x * x + y * y)), 6) as max_r, round((min(sqrt(x * x + y * y)) + max(sqrt(x * x + y * y))) / 2, 6) as mean_r, round(median(sqrt(x * x + y * y)), 6) as median_r from nodes"""
)
def mesh_extents(spark, d):
    """A16, A25."""
    e = mesh.extents(views.nodes(spark, d))
    return rounded(e, *e.columns)


@query(f"with {NODES} select round(sqrt(x * x + y * y), 6) as r, round(z, 6) as zz, min(node_id) as point_id, count(*) as merged from nodes group by 1, 2")
def meridional_merge(spark, d):
    """A28."""
    return mesh.merge_meridional(views.nodes(spark, d), 6)


_PANELS = """s as (select s_suppkey, (s_suppkey % 10)::bigint as line, 1 + (s_suppkey % 37) / 10.0::double as r, (s_suppkey % 53) / 10.0::double as z from supplier),
 p as (select line, s_suppkey, r, z, lead(r) over w as r2, lead(z) over w as z2 from s window w as (partition by line order by s_suppkey)), panel as (select line, s_suppkey, (r + r2) / 2 as r_mid, (z + z2) / 2 as z_mid, sqrt((r2 - r) ** 2 + (z2 - z) ** 2) as len, r2 - r as dr, z2 - z as dz from p where r2 is not null)"""


def _panels(spark, d):
    k = F.col("s_suppkey")
    return mesh.panels(views.table(spark, d, "supplier").select("s_suppkey", (k % 10).alias("line"), (1 + k % 37 / 10.0).alias("r"), (k % 53 / 10.0).alias("z")), ["line"], ["s_suppkey"])


@query(f"with {_PANELS} select line, s_suppkey, round(r_mid, 6) as r_mid, round(z_mid, 6) as z_mid, round(len, 6) as len, round(case when len > 0 then -dz / len else 0 end, 6) as nr, round(case when len > 0 then dr / len else 0 end, 6) as nz from panel")
def meridional_panels(spark, d):
    """P29, W5."""
    names = ("r_mid", "z_mid", "len", "nr", "nz")
    return rounded(_panels(spark, d).select("line", "s_suppkey", *names), *names)


@query(
    f"with {NODES}, {_PANELS}, x as (select node_id, s_suppkey, round(sqrt((sqrt(x * x + y * y) - r_mid) ** 2 + (nodes.z - z_mid) ** 2), 6) as distance from nodes, panel) select node_id as point_id, min(distance) as distance from x group by all"
)
def nearest_panel(spark, d):
    """J11."""
    points = views.nodes(spark, d).select(F.col("node_id").alias("point_id"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("r"), "z")
    return rounded(mesh.nearest_panel(points, _panels(spark, d).select(F.col("s_suppkey").alias("panel_id"), "r_mid", "z_mid")).select("point_id", "distance"), "distance")


@query(f"with {NODES}, t as (select z, atan2(y, x) as theta from nodes), g as (select z, coalesce(lead(theta) over (partition by z order by theta) - theta, min(theta) over (partition by z) + {TWO_PI} - theta) as gap from t) select round(z, 6) as z, round(max(gap), 6) as max_gap, round({TWO_PI} - max(gap), 6) as span from g group by z")
def angular_gap(spark, d):
    """W10."""
    return rounded(mesh.max_gap(views.nodes(spark, d).select("z", F.atan2("y", "x").alias("theta")), ["z"]), "z", "max_gap", "span")


@query(f"with {NODES} select node_id, round(sqrt(x * x + y * y), 6) as r, round((x * 0.3 + y * z) / sqrt(x * x + y * y), 6) as ur, round((x * z - y * 0.3) / sqrt(x * x + y * y), 6) as ut from nodes")
def cylindrical(spark, d):
    """P20."""
    r, ur, ut = physics.cylindrical(F.col("x"), F.col("y"), F.lit(0.3), F.col("z"))
    return rounded(views.nodes(spark, d).select("node_id", r.alias("r"), ur.alias("ur"), ut.alias("ut")), "r", "ur", "ut")


@query(
    """with e as (select vec_id, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings), p as (select vec_id, i // 3 as n, max(case when i % 3 = 0 then v * v end) as r2, max(case when i % 3 = 1 then v * v end) as t2, max(case when i % 3 = 2 then v * v end) as a2 from e where i < 63 group by all),
 q as (select vec_id, sqrt(sum(r2) / count(*)) as r, sqrt(sum(t2) / count(*)) as t, sqrt(sum(a2) / count(*)) as a from p group by all) select vec_id, round(r, 6) as r, round(t, 6) as t, round(a, 6) as a, case when r + t + a < 1e-15 then 'B' when a / (r + t + a) > 0.5 then 'B' when t / (r + t + a) > 0.5 then 'T' else 'A' end as family from q"""
)
def family_class(spark, d):
    """A8."""
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*[F.pow(F.get("shape", 3 * i + j), 2).alias(n) for j, n in enumerate(("ur2", "ut2", "ua2"))]))).alias("p")
    return rounded(response.family_class(views.shapes(spark, d).select("vec_id", parts).select("vec_id", "p.*"), ["vec_id"]), "r", "t", "a")


@query("with s as (select user_id, value - 50 as v, ts, event_id from events), l as (select user_id, sign(v) as s, lag(sign(v)) over (partition by user_id order by ts, event_id) as b from s where abs(v) > 5) select user_id, sum(coalesce((s <> b)::int, 0))::bigint as crossings from l group by all")
def zero_crossings(spark, d):
    """W3."""
    s = views.table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") - 50).alias("v"))
    return response.zero_crossings(s, ["user_id"], ["ts", "event_id"], "v", 5.0)


_WEIGHT = "exp(-0.5 * ((b.bin - a.bin) / 1.5::double) ** 2)"


@query(
    f"""with b as (select user_id % 20 as track, least(greatest(floor((hour(ts) * 60 + minute(ts)) / 36.0), 0), 39)::int as bin, avg(value) as mean from events group by all),
 g as (select track, unnest(range(40))::int as bin from (select distinct track from b)), j as (select track, bin, mean from g left join b using (track, bin)),
 n as (select track, bin, last_value(mean ignore nulls) over p as v0, last_value(case when mean is not null then bin end ignore nulls) over p as b0, first_value(mean ignore nulls) over q as v1, first_value(case when mean is not null then bin end ignore nulls) over q as b1 from j
  window p as (partition by track order by bin rows between unbounded preceding and current row), q as (partition by track order by bin rows between current row and unbounded following)),
 f as (select track, bin, case when v0 is null then v1 when v1 is null then v0 else v0 + (v1 - v0) * (bin - b0) / greatest(b1 - b0, 1) end as value from n)
 select a.track, a.bin, round(sum(b.value * {_WEIGHT}) / sum({_WEIGHT}), 6) as smooth from f a join f b on a.track = b.track and abs(a.bin - b.bin) <= 5 group by all"""
)
def gaussian_smooth(spark, d):
    """A19, W4."""
    e = views.table(spark, d, "events").select((F.col("user_id") % 20).alias("track"), (F.hour("ts") * 60 + F.minute("ts")).alias("at"), "value")
    rows = response.binned(e, ["track"], "at", "value", 0.0, 1440.0, 40)
    return rounded(response.smoothed(rows, ["track"], 40).select("track", "bin", "smooth"), "smooth")


@query("with v as (select user_id, (event_id % 9)::bigint as votes from events) select user_id, list_sort(list(votes))[count(*) // 2 + 1] as vote from v group by all")
def median_vote(spark, d):
    """A20."""
    return response.upper_median(views.table(spark, d, "events").select("user_id", (F.col("event_id") % 9).alias("votes")), ["user_id"], "votes")


@query(f"with {TRUTH} select nd, round(coalesce(avg(rel), 0), 4) as mean_err, round(coalesce(max(rel), 0), 4) as max_err, round(coalesce(stddev_pop(rel), 0), 4) as std_err, count(rel) as n_modes from rel group by nd")
def diagnose(spark, d):
    """J13, F16, A13."""
    return rounded(response.error_stats(response.errors(*views.truth(spark, d))), "mean_err", "max_err", "std_err", digits=4)


@query(f"with {TRUTH} select nd, j, round(greatest(coalesce(rel, -1), 0), 4) as rel from rel order by coalesce(rel, -1) desc, nd, j limit 1")
def worst_mode(spark, d):
    """A14."""
    return rounded(response.worst(response.errors(*views.truth(spark, d))), "rel", digits=4)


@query(
    f"""with {MODAL}, v as (select *, case when mode_idx % 2 = 0 then 900.0::double end as velocity, {TWO_PI} * freq_hz * 0.3 / nullif(k, 0) as expected, min(case when whirl = 1 then freq_hz end) over (partition by rpm, k) as fw, max(case when whirl = -1 then freq_hz end) over (partition by rpm, k) as bw from modal),
 c as (select *, freq_hz > 0 as c1, k between 0 and 10 as c2, whirl in (-1, 0, 1) as c3, rpm <= 0 or coalesce(fw >= bw, true) as c4, velocity is null or k = 0 or abs(velocity - expected) <= 0.5 * expected as c5 from v)
 select rpm, k, mode_idx, round((c1::int + c2::int + c3::int + c4::int + c5::int) / 5.0::double, 6) as score, c1 and c2 and c3 and c4 and c5 as is_consistent, (c1::int + c2::int + c3::int + c4::int + c5::int) / 5.0::double < 0.8 as anomaly,
 concat_ws(',', case when not c1 then 'frequency' end, case when not c2 then 'nodal_diameter' end, case when not c3 then 'whirl' end, case when not c4 then 'splitting' end, case when not c5 then 'velocity' end) as violations from c"""
)
def consistency(spark, d):
    """P9."""
    rows = views.modal(spark, d).withColumn("velocity", F.when(F.col("mode_idx") % 2 == 0, 900.0))
    out = response.consistency(rows, 20, 0.3).withColumn("violations", F.array_join("violations", ","))
    return rounded(out.select("rpm", "k", "mode_idx", "score", "is_consistent", "anomaly", "violations"), "score")


@query(f"with {MODAL} select rpm, count(distinct k) as completed, count(*) as modes, min(freq_hz) as min_hz, max(freq_hz) as max_hz, bool_and(whirl <> 0) as converged from modal group by rpm")
def convergence(spark, d):
    """A26."""
    return response.counters(views.modal(spark, d).withColumn("converged", F.col("whirl") != 0))


@query(
    f"""with {NODES}, g as (select *, ['FIXED', 'DISPLACEMENT', 'FRICTIONLESS', 'ELASTIC', 'CYLINDRICAL'][node_id % 5 + 1] as type from nodes)
 select node_id, unnest(case type when 'FIXED' then [0, 1, 2] when 'DISPLACEMENT' then [0, 2] when 'FRICTIONLESS' then [1] when 'CYLINDRICAL' then (case when abs(x) >= abs(y) then [0, 2] else [1, 2] end) else []::int[] end)::int as d from g"""
)
def constrained_dofs(spark, d):
    """L8."""
    names = F.array(*map(F.lit, ("FIXED", "DISPLACEMENT", "FRICTIONLESS", "ELASTIC", "CYLINDRICAL")))
    n = views.nodes(spark, d).select("node_id", "x", "y", F.element_at(names, (F.col("node_id") % 5 + 1).cast("int")).alias("type"))
    return mesh.constrained(n.withColumn("locked", F.array(F.lit(True), F.lit(False), F.lit(True))).withColumn("normal", F.array(F.lit(0.1), F.lit(-0.9), F.lit(0.9))))


@query(f"with {NODES}, s as (select node_id, unnest([0, 1, 2]) as d, unnest([x, 0.0::double, z]) as val from nodes) select 3 * node_id + d as row, 3 * node_id + d as col, val from s where val > 0")
def spring_diagonal(spark, d):
    """L9."""
    return mesh.spring_diagonal(views.nodes(spark, d).select("node_id", F.col("x").alias("kx"), F.lit(0.0).alias("ky"), F.col("z").alias("kz")))


@query(
    f"with {SPLIT} select printf('%.6f', rpm) as rpm, k as harmonic_index, row_number() over (partition by rpm, k order by freq_hz, whirl, mode_idx)::int as mode_family, printf('%.6f', freq_hz) as frequency_hz, whirl as whirl_direction from stationary"
)
def campbell_csv(spark, d):
    """The text of each field of the file."""
    return results.campbell_rows(views.modal(spark, d), SECTORS)


@query(f"with {MODAL} select k as nodal_diameter, row_number() over (partition by rpm, k order by freq_hz, mode_idx)::int as mode_family, printf('%.6f', freq_hz) as frequency_hz, printf('%.6f', rpm) as rpm from modal")
def zzenf_csv(spark, d):
    """S11."""
    return results.zzenf_rows(views.modal(spark, d))


@query()
def mode_tracking(spark, d):
    """Tracks of shapes over speeds; shapes of a harmonic are dealt to speeds and modes by id."""
    s = views.shapes(spark, d).select("k", (F.col("vec_id") % 7 * 1000.0).alias("rpm"), "vec_id", "shape")
    rows = modal.ranked(s, ["k", "rpm"], ["vec_id"], "n").select("k", "rpm", (F.col("n") - 1).alias("mode_idx"), "shape")
    return modal.tracked(rows)


@query()
def mistuned_modes(spark, d):
    """suppliers' balances as patterns of 24 blades."""
    s = views.table(spark, d, "customer").select((F.col("c_custkey") / 24).cast("long").alias("pattern"), (F.col("c_custkey") % 24).cast("int").alias("blade"), (F.col("c_acctbal") / 2e5).alias("delta"))
    full = s.groupBy("pattern").agg(F.count_distinct("blade").alias("n")).where("n = 24").select("pattern")
    return response.mistuned(s.join(full, "pattern", "left_semi"), [500.0 + 100 * i for i in range(13)], SECTORS)


@query()
def cyclic_sweep(spark, d):
    """A generated sector, for the speeds of the modal view."""
    parts = fem.annulus_sector(spark, radial=1, around=1)
    speeds = views.modal(spark, d).select("rpm").distinct().select((F.col("rpm") / 1000).cast("int").alias("cond_id"), "rpm")
    return fem.sector_modes(parts["elements"], parts["nodes"], parts["sets"], speeds, SECTORS, 4, {"e": 2e11, "nu": 0.3, "rho": 7800.0}).select("cond_id", "rpm", "k", "mode_idx", F.round("freq_hz", 3).alias("freq_hz"), "whirl", "status")
