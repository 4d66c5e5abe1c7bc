"""Forced response, participation, mistuning and frequency diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.pairs import dot, squared, times


def sweep(n: int, low: Column, high: Column) -> Column:
    """N points from low to high, ends included, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / max(n - 1, 1))


def auto_range(modes: DataFrame) -> DataFrame:
    """One row with half the lowest and 1.5 times the highest frequency."""
    return modes.agg((F.min("freq_hz") * 0.5).alias("low"), (F.max("freq_hz") * 1.5).alias("high"))


def frf(modes: DataFrame, points: int, zeta: Column, low: Column, high: Column) -> DataFrame:
    """Complex response of each mode (freq_hz, q_re, q_im) over a frequency sweep.

    Rows multiply by ``points`` within their task; nothing is shuffled.
    """
    rest = modes.columns
    rows = modes.select(*rest, zeta.alias("zeta"), F.posexplode(sweep(points, low, high)).alias("step", "f_hz"))
    re, im = physics.modal_frf((F.col("q_re"), F.col("q_im")), F.col("freq_hz") * physics.TWO_PI, F.col("f_hz") * physics.TWO_PI, F.col("zeta"))
    return rows.select(*rest, "step", "f_hz", re.alias("h_re"), im.alias("h_im"))


def peak(response: DataFrame, keys: list[str]) -> DataFrame:
    """The largest magnitude of each mode and the first frequency that has it."""
    size = F.sqrt(squared((F.col("h_re"), F.col("h_im"))))
    best = response.groupBy(*keys).agg(F.max(F.struct(size.alias("m"), (-F.col("f_hz")).alias("f"))).alias("best"))
    return best.select(*keys, F.col("best.m").alias("peak"), (-F.col("best.f")).alias("peak_hz"))


def excitation(nodes: DataFrame, eo: Column, amplitude: float, point: int | None = None, direction: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Force on each degree of freedom: at one node, or along z with the phase of an engine order."""
    if point is not None:
        rows = nodes.where(F.col("node_id") == point)
        parts = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(amplitude * x).alias("re"), F.lit(0.0).alias("im")) for d, x in enumerate(direction)])
        return rows.select("node_id", F.explode(parts).alias("p")).select("node_id", "p.d", "p.re", "p.im")
    angle = eo * F.atan2("y", "x")
    return nodes.select("node_id", F.lit(2).alias("d"), (amplitude * F.cos(angle)).alias("re"), (amplitude * F.sin(angle)).alias("im"))


def modal_forces(shapes: DataFrame, force: DataFrame, keys: list[str], hermitian: bool = False) -> DataFrame:
    """Sum over degrees of freedom of shape times force, unconjugated unless asked (Q2)."""
    f = force.select("node_id", "d", F.col("re").alias("f_re"), F.col("im").alias("f_im"))
    im = -F.col("im") if hermitian else F.col("im")
    re_, im_ = times((F.col("re"), im), (F.col("f_re"), F.col("f_im")))
    return shapes.join(f, ["node_id", "d"]).groupBy(*keys).agg(F.sum(re_).alias("q_re"), F.sum(im_).alias("q_im"))


def participation(shapes: DataFrame, mass: Column, direction: Column) -> DataFrame:
    """A9, A10, A5 for arrays and a diagonal mass: factor, effective and generalised mass."""
    weighted = F.zip_with("shape", mass, lambda x, m: x.cast("double") * m)
    rest = shapes.columns
    out = shapes.withColumn("gamma", F.abs(dot(weighted, direction))).withColumn("gen_mass", F.abs(dot(weighted, F.col("shape"))))
    return out.select(*rest, "gamma", "gen_mass", F.when(F.col("gen_mass") > 1e-30, F.col("gamma") * F.col("gamma") / F.col("gen_mass")).otherwise(0.0).alias("eff_mass"))


def localisation(amplitudes: DataFrame, sectors: int) -> DataFrame:
    """Magnification and inverse participation ratio of each pattern's modes (re, im by blade)."""
    a2 = squared((F.col("re"), F.col("im")))
    sums = amplitudes.groupBy("pattern", "mode").agg(F.max(F.sqrt(a2)).alias("top"), F.sum(a2).alias("s2"), F.sum(a2 * a2).alias("s4"))
    return sums.select("pattern", "mode", (F.col("top") * float(np.sqrt(sectors))).alias("magnification"), F.when(F.col("s2") > 1e-30, sectors * F.col("s4") / (F.col("s2") * F.col("s2"))).otherwise(1.0).alias("ipr"))


def mistuned(patterns: DataFrame, tuned_hz: list[float], sectors: int) -> DataFrame:
    """Modes of each pattern (pattern, blade, delta) in the fundamental mistuning model.

    One N x N Hermitian problem per pattern. Returns pattern, mode, freq_hz, magnification, ipr.
    """
    f = np.asarray(tuned_hz, float)
    index = np.arange(sectors)
    nd = np.minimum(np.minimum(index, sectors - index), len(f) - 1)
    basis = np.exp(2j * np.pi * np.outer(index, index) / sectors) / np.sqrt(sectors)
    tuned = (basis * (2 * np.pi * f[nd]) ** 2) @ basis.conj().T
    scale = 2 * (2 * np.pi * f.mean()) ** 2

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        if sorted(rows["blade"]) != list(range(sectors)):
            raise ValueError("a pattern needs one deviation for each blade")
        delta = rows.sort_values("blade")["delta"].to_numpy(float)
        values, vectors = np.linalg.eigh(tuned + np.diag(scale * delta))
        a2 = np.abs(vectors) ** 2
        return pd.DataFrame({
            "pattern": rows["pattern"].iloc[0], "mode": np.arange(sectors), "freq_hz": np.sqrt(np.maximum(values, 0)) / (2 * np.pi),
            "magnification": np.sqrt(a2.max(axis=0) * sectors), "ipr": sectors * (a2**2).sum(axis=0) / a2.sum(axis=0) ** 2,
        })

    return patterns.groupBy("pattern").applyInPandas(solve, "pattern long, mode int, freq_hz double, magnification double, ipr double")


def random_patterns(spark, patterns: int, sectors: int, sigma: float, seed: int) -> DataFrame:
    """Normal deviations; a generator of its own, so that draws differ from other libraries'."""
    rows = spark.range(patterns * sectors).select((F.col("id") / sectors).cast("long").alias("pattern"), (F.col("id") % sectors).cast("int").alias("blade"))
    return rows.withColumn("delta", F.randn(seed) * sigma)


def errors(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """Relative errors in percent of computed against true frequencies by (nd, j); null where either lacks."""
    both = truth.select("nd", "j", F.nullif(F.col("freq_hz"), F.lit(float("nan"))).alias("gt")).join(computed.select("nd", "j", F.nullif(F.col("freq_hz"), F.lit(float("nan"))).alias("comp")), ["nd", "j"], "left")
    return both.withColumn("rel", F.when(F.abs("gt") >= 1e-12, F.abs(F.col("comp") - F.col("gt")) / F.abs("gt") * 100))


def error_stats(rel: DataFrame) -> DataFrame:
    """Mean, largest and population deviation of the error by nodal diameter; zeros where empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rel.groupBy("nd").agg(zero(F.avg("rel")).alias("mean_err"), zero(F.max("rel")).alias("max_err"), zero(F.stddev_pop("rel")).alias("std_err"), F.count("rel").alias("n_modes"))


def worst(rel: DataFrame) -> DataFrame:
    """The first (nd, j) with the largest error, as one row."""
    best = F.max(F.struct(F.coalesce("rel", F.lit(-1.0)).alias("r"), (-F.col("nd")).alias("nd"), (-F.col("j")).alias("j"))).alias("b")
    return rel.agg(best).where("b is not null").select((-F.col("b.nd")).alias("nd"), (-F.col("b.j")).alias("j"), F.greatest("b.r", F.lit(0.0)).alias("rel"))


def consistency(modes: DataFrame, sectors: int, radius: float, tolerance: float = 0.5) -> DataFrame:
    """Five checks of each row, their score, and whether the row is an anomaly.

    Modes: rpm, k, mode_idx, freq_hz, whirl, velocity (a measured wave velocity or null).
    """
    w = Window.partitionBy("rpm", "k")
    fw, bw = F.min(F.when(F.col("whirl") == 1, F.col("freq_hz"))).over(w), F.max(F.when(F.col("whirl") == -1, F.col("freq_hz"))).over(w)
    expected = physics.wave_velocity(F.col("freq_hz"), F.col("k"), radius)
    checks = {
        "frequency": F.col("freq_hz") > 0, "nodal_diameter": F.col("k").between(0, sectors // 2), "whirl": F.col("whirl").isin(-1, 0, 1),
        "splitting": (F.col("rpm") <= 0) | F.coalesce(fw >= bw, F.lit(True)),
        "velocity": F.col("velocity").isNull() | (expected == 0) | (F.abs(F.col("velocity") - expected) <= tolerance * expected),
    }
    passed = sum((c.cast("int") for c in checks.values()), F.lit(0))
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]))
    out = modes.withColumn("violations", failed).withColumn("score", passed / len(checks))
    return out.withColumn("is_consistent", F.size("violations") == 0).withColumn("anomaly", F.col("score") < 0.8)


def counters(status: DataFrame) -> DataFrame:
    """Progress of a condition: completed harmonics, frequency range, and whether all converged."""
    return status.groupBy("rpm").agg(F.count_distinct("k").alias("completed"), F.count("*").alias("modes"), F.min("freq_hz").alias("min_hz"), F.max("freq_hz").alias("max_hz"), F.bool_and("converged").alias("converged"))


def family_class(parts: DataFrame, keys: list[str]) -> DataFrame:
    """B (axial share of RMS above one half), T (tangential) or A, from rows ur2, ut2, ua2."""
    rms = lambda c: F.sqrt(F.sum(c) / F.count("*"))
    sums = parts.groupBy(*keys).agg(rms("ur2").alias("r"), rms("ut2").alias("t"), rms("ua2").alias("a"))
    total = F.col("r") + F.col("t") + F.col("a")
    label = F.when(total < 1e-15, "B").when(F.col("a") / total > 0.5, "B").when(F.col("t") / total > 0.5, "T").otherwise("A")
    return sums.withColumn("family", label)


def zero_crossings(samples: DataFrame, keys: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """Sign changes between successive samples outside a dead band."""
    w = Window.partitionBy(*keys).orderBy(*order)
    loud = samples.where(F.abs(value) > threshold).withColumn("sign", F.signum(value))
    return loud.withColumn("changed", F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("long"), F.lit(0))).groupBy(*keys).agg(F.sum("changed").alias("crossings"))


def binned(samples: DataFrame, keys: list[str], position: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Mean of the samples in each of ``bins`` equal bins; empty bins have no row."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col(position) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return samples.groupBy(*keys, at.alias("bin")).agg(F.avg(value).alias("mean"))


def smoothed(rows: DataFrame, keys: list[str], bins: int, sigma: float = 1.5) -> DataFrame:
    """Gaps filled between their nearest neighbours (edges held), then a truncated Gaussian."""
    half = int(np.ceil(3 * sigma))
    grid = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(rows, [*keys, "bin"], "left")
    w = Window.partitionBy(*keys).orderBy("bin")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col("mean").isNotNull(), F.col("bin"))
    near = full.select(*keys, "bin", *[f(c, ignorenulls=True).over(x).alias(n) for n, f, c, x in (("v0", F.last, "mean", back), ("b0", F.last, place, back), ("v1", F.first, "mean", on), ("b1", F.first, place, on))])
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("bin") - F.col("b0")) / F.greatest(F.col("b1") - F.col("b0"), F.lit(1))
    filled = near.select(*keys, "bin", F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull(), F.col("v0")).otherwise(between).alias("value"))
    weights = {d: float(np.exp(-0.5 * (d / sigma) ** 2)) for d in range(-half, half + 1)}
    shifted = {d: F.lead("value", d).over(w) if d >= 0 else F.lag("value", -d).over(w) for d in weights}
    top = sum((F.coalesce(x * weights[d], F.lit(0.0)) for d, x in shifted.items()), F.lit(0.0))
    mass = sum((F.when(x.isNotNull(), weights[d]).otherwise(0.0) for d, x in shifted.items()), F.lit(0.0))
    return filled.withColumn("smooth", top / mass)


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper median of the votes of each group."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select(*keys, F.col(value).alias("vote"))


def nodal_circles(samples: DataFrame, max_lines: int = 9) -> DataFrame:
    """Circles of each mode from samples (mode, r, theta, value): lines at constant angle,
    binned, smoothed, normalised and counted; the median line decides. Complex samples are
    brought in phase first (``studies.in_phase``)."""

    def count(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        r, theta, value = (rows[c].to_numpy(float) for c in ("r", "theta", "value"))
        span, out = r.max() - r.min(), []
        if len(rows) >= 10 and span > 0:
            low, high = theta.min(), theta.max()
            lines = max(3, min(max_lines, int(np.degrees(high - low))))
            margin = 0.08 * (high - low)
            centres = np.linspace(low + margin, high - margin, lines)
            width = np.clip(0.45 * (centres[1] - centres[0]), 0.02 * (high - low), 0.06 * (high - low))
            for c in centres:
                near = np.abs(theta - c) <= width
                if near.sum() >= 5:
                    out.append(_circles_on_line(r[near], value[near], r.min(), span))
        votes = sorted(out)
        return pd.DataFrame({"mode": [rows["mode"].iloc[0]], "circles": [votes[len(votes) // 2] if votes else 0]})

    return samples.groupBy("mode").applyInPandas(count, "mode long, circles int")


def _circles_on_line(r: np.ndarray, value: np.ndarray, low: float, span: float, sigma: float = 1.5, threshold: float = 0.05) -> int:
    bins = int(np.clip(2 * np.sqrt(len(r)), 10, 40))
    at = np.clip(((r - low) / span * bins).astype(int), 0, bins - 1)
    n = np.bincount(at, minlength=bins)
    full = np.flatnonzero(n)
    line = np.interp(np.arange(bins), full, (np.bincount(at, value, bins) / np.maximum(n, 1))[full])
    half = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    line = np.convolve(line, kernel, "same")[:bins] / np.convolve(np.ones(bins), kernel, "same")[:bins]
    top = np.abs(line).max()
    loud = line[np.abs(line) > threshold * top] if top > 0 else line[:0]
    return int(np.sum(np.sign(loud[1:]) != np.sign(loud[:-1])))
