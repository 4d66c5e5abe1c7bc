"""Rows of modes: ranking, splitting, expansion, families, Campbell and zig-zag tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.pairs import dot, squared
from ..kernels import tracking


def stationary_split(modes: DataFrame, sectors: int, coriolis: Column | None = None) -> DataFrame:
    """Modes (rpm, k, freq_hz, whirl) in the stationary frame.

    Where a condition and harmonic has whirl labels, each row shifts by its own
    (``abs(f + w k Omega)``); where it has none, travelling modes (0 < k < N // 2) become a
    backward and a forward row. Rows at rest or with k = 0, and without labels, pass with
    whirl 0. ``coriolis`` says which branch a row takes; without it, any non-zero whirl of
    the condition and harmonic does, which takes a shuffle.
    """
    shift = F.col("k") * F.abs(F.col("rpm")) / 60
    moves = (F.col("k") > 0) & (F.col("rpm") != 0)
    labelled = F.max(F.abs("whirl")).over(Window.partitionBy("rpm", "k")) > 0 if coriolis is None else coriolis
    rows = modes.withColumn("__labelled", labelled)
    row = lambda f, w: F.struct(f.alias("freq_hz"), w.cast("int").alias("whirl"))
    split = F.array(row(F.abs(F.col("freq_hz") - shift), F.lit(-1)), row(F.col("freq_hz") + shift, F.lit(1)))
    own = F.array(row(F.abs(F.col("freq_hz") + F.col("whirl") * shift), F.col("whirl")))
    out = F.when(moves & F.col("__labelled"), own).when(moves & (F.col("k") < sectors // 2), split).otherwise(F.array(row(F.col("freq_hz"), F.lit(0))))
    rest = [c for c in modes.columns if c not in ("freq_hz", "whirl")]
    return rows.select(*rest, F.explode(out).alias("s")).select(*rest, "s.freq_hz", "s.whirl")


def ranked(modes: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based rank inside each group."""
    return modes.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def lowest(modes: DataFrame, n: int, floor: float = 0.0) -> DataFrame:
    """The n lowest modes above ``floor`` of each condition and harmonic."""
    return ranked(modes.where(F.col("freq_hz") > floor), ["rpm", "k"], ["freq_hz", "mode_idx"]).where(F.col("rank") <= n)


def by_sign(modes: DataFrame, n: int) -> DataFrame:
    """Up to n forward and n backward roots by magnitude; roots near zero are skipped."""
    signed = modes.where(F.abs("omega") >= 1e-6).withColumn("sign", F.signum("omega").cast("int"))
    return ranked(signed, ["rpm", "k", "sign"], [F.abs("omega"), "mode_idx"]).where(F.col("rank") <= n)


def expand_degenerate(modes: DataFrame, sectors: int, most: int) -> DataFrame:
    """Each mode of a degenerate harmonic twice, with whirl +1 and -1, ``most`` rows at most."""
    twice = F.when(physics.degenerate(F.col("k"), sectors), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(0)))
    rest = [c for c in modes.columns if c != "whirl"]
    out = modes.select(*rest, F.explode(twice).alias("whirl"))
    return ranked(out, ["rpm", "k"], ["freq_hz", "mode_idx", F.desc("whirl")], "expanded_idx").where(F.col("expanded_idx") <= most)


def campbell(modes: DataFrame, sectors: int, most: int | None = None) -> DataFrame:
    """E3 (U1, T5, W8): stationary modes in order of frequency, as a long table."""
    out = ranked(stationary_split(modes, sectors), ["rpm", "k"], ["freq_hz", "whirl", "mode_idx"], "family")
    return out if most is None else out.where(F.col("family") <= most)


def padded(campbell_rows: DataFrame) -> tuple[np.ndarray, list, list]:
    """(conditions, harmonics, families) with NaN where there is no row, for small tables."""
    rows = campbell_rows.select("rpm", "k", "family", "freq_hz").toPandas()
    rpm, k = sorted(rows["rpm"].unique()), sorted(rows["k"].unique())
    out = np.full((len(rpm), len(k), int(rows["family"].max() or 0)), np.nan)
    out[np.searchsorted(rpm, rows["rpm"]), np.searchsorted(k, rows["k"]), rows["family"].to_numpy() - 1] = rows["freq_hz"]
    return out, rpm, k


def families(modes: DataFrame, sectors: int) -> DataFrame:
    """Folded nodal diameter, and the family index with degenerate pairs as one."""
    nd = physics.folded(F.col("k"), sectors)
    index = F.when(physics.degenerate(nd, sectors), F.floor(F.col("mode_idx") / 2)).otherwise(F.col("mode_idx")).cast("int")
    return modes.withColumn("nd", nd).withColumn("family", index)


def first_per_diameter(points: DataFrame) -> DataFrame:
    """The lowest point of each family and nodal diameter."""
    return ranked(points, ["family", "nd"], ["freq_hz", "mode_idx", "rpm"]).where("rank = 1").drop("rank")


def family_order(points: DataFrame) -> DataFrame:
    """Families by their lowest frequency."""
    return points.groupBy("family").agg(F.min("freq_hz").alias("min_freq"))


def dominant_whirl(tracks: DataFrame) -> DataFrame:
    """Forward unless backward rows are more."""
    return tracks.groupBy("k", "mode_idx").agg(F.when(F.count_if(F.col("whirl") == 1) >= F.count_if(F.col("whirl") == -1), 1).otherwise(-1).alias("dominant"))


def crossings(tracks: DataFrame, orders: DataFrame) -> DataFrame:
    """Where tracks (k, mode_idx, rpm, freq_hz) cross the lines ``order * rpm / 60``.

    Neighbours on a track with strictly opposite distances to the line, interpolated between.
    """
    w = Window.partitionBy("k", "mode_idx").orderBy("rpm")
    pairs = tracks.withColumn("rpm2", F.lead("rpm").over(w)).withColumn("freq2", F.lead("freq_hz").over(w)).where("rpm2 is not null")
    d1, d2 = F.col("freq_hz") - F.col("eo") * F.col("rpm") / 60, F.col("freq2") - F.col("eo") * F.col("rpm2") / 60
    out = pairs.crossJoin(orders).withColumn("d1", d1).withColumn("d2", d2).where("d1 * d2 < 0")
    at = F.col("rpm") + F.abs("d1") / (F.abs("d1") + F.abs("d2")) * (F.col("rpm2") - F.col("rpm"))
    return out.select("k", "mode_idx", "eo", at.alias("cross_rpm"), (F.col("eo") * at / 60).alias("cross_hz"))


def order_lines(rpms: DataFrame, orders: DataFrame, top: float) -> DataFrame:
    """Points of engine-order lines up to ``top`` Hz; orders are a short list."""
    return rpms.crossJoin(orders).withColumn("line_hz", F.col("eo") * F.col("rpm") / 60).where(F.col("line_hz") <= top)


def zigzag(rpms: DataFrame, sectors: int, top: float) -> DataFrame:
    """The folded excitation line of each speed; engine orders from 0 until above ``top``."""
    e = F.explode(F.sequence(F.lit(0), (F.floor(top / (F.col("rpm") / 60)) + 1).cast("int"))).alias("e")
    return rpms.where("rpm > 0").select("rpm", e).select("rpm", "e", physics.folded(F.col("e"), sectors).alias("nd"), (F.col("e") * F.col("rpm") / 60).alias("line_hz"))


def tyler_sofrin(vanes: list[int], harmonics: int, sectors: int, spark, span: int = 50) -> DataFrame:
    """Nodal diameters that n-th vane passing excites: ``abs(n V - m N)`` folded, distinct."""
    v = spark.createDataFrame([(x,) for x in vanes], "vanes int")
    n, m = spark.range(1, harmonics + 1).select(F.col("id").cast("int").alias("n")), spark.range(-span, span + 1).select(F.col("id").cast("int").alias("m"))
    order = F.abs(F.col("n") * F.col("vanes") - F.col("m") * sectors)
    return v.crossJoin(n).crossJoin(m).select("vanes", "n", physics.folded(order, sectors).cast("int").alias("nd")).distinct()


def excited(modes: DataFrame, orders: DataFrame, sectors: int) -> DataFrame:
    """Modes by the engine orders that excite them, as an equi-join on the folded order."""
    return modes.withColumn("nd", physics.folded(F.col("k"), sectors)).join(orders.withColumn("nd", physics.folded(F.col("eo"), sectors)), "nd").drop("nd")


def mac(a: Column, b: Column, floor: float = 1e-300) -> Column:
    """A6 for real shapes: squared cosine, with the denominator's floor (Q13)."""
    return F.pow(dot(a, b), 2) / F.greatest(dot(a, a) * dot(b, b), F.lit(floor))


def mac_complex(a: tuple[Column, Column], b: tuple[Column, Column], floor: float = 1e-300) -> Column:
    """A6 for complex shapes, as arrays of real and imaginary parts."""
    re, im = dot(a[0], b[0]) + dot(a[1], b[1]), dot(a[0], b[1]) - dot(a[1], b[0])
    norms = (dot(a[0], a[0]) + dot(a[1], a[1])) * (dot(b[0], b[0]) + dot(b[1], b[1]))
    return squared((re, im)) / F.greatest(norms, F.lit(floor))


def track(pairs: DataFrame) -> DataFrame:
    """Tracks over rpm from MACs of neighbouring speeds, harmonic by harmonic.

    ``pairs``: k, step, rpm, rpm2, i, j, mac for each mode i at a speed and j at the next speed
    that has the harmonic. The greedy chain (best MAC first, ties by larger track, then larger
    mode) is the only sequential part: it needs one small group per harmonic.
    Returns k, rpm, track, mode_idx.
    """

    def chain(key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out, held = [], None
        for _, step in sorted(rows.groupby("step"), key=lambda x: x[0]):
            size = int(step["i"].max()) + 1
            table = np.zeros((size, int(step["j"].max()) + 1))
            table[step["i"], step["j"]] = step["mac"]
            if held is None:
                held = {t: t for t in range(size)}
                out += [(key[0], step["rpm"].iloc[0], t, m) for t, m in held.items()]
            n = min(size, len(held))
            order = sorted(((table[held[t], j] if 0 <= held[t] < size else 0.0, t, j) for t in range(n) for j in range(table.shape[1])), reverse=True)
            new, used = dict.fromkeys(held, -1), set()
            for _, t, j in order:
                if new[t] < 0 and j not in used:
                    new[t] = j
                    used.add(j)
            held = new
            out += [(key[0], step["rpm2"].iloc[0], t, m) for t, m in held.items()]
        return pd.DataFrame(out, columns=["k", "rpm", "track", "mode_idx"])

    return pairs.groupBy("k").applyInPandas(chain, "k int, rpm double, track int, mode_idx int")


def mac_neighbours(shapes: DataFrame) -> DataFrame:
    """MACs of all modes at a speed against all modes at the next one that has the harmonic.

    ``shapes``: k, rpm, mode_idx (from 0), shape (array of doubles).
    """
    w = Window.partitionBy("k").orderBy("rpm")
    steps = shapes.select("k", "rpm").distinct().withColumn("step", F.row_number().over(w)).withColumn("rpm2", F.lead("rpm").over(w)).where("rpm2 is not null")
    a = shapes.select("k", "rpm", F.col("mode_idx").alias("i"), F.col("shape").alias("a"))
    b = shapes.select("k", F.col("rpm").alias("rpm2"), F.col("mode_idx").alias("j"), F.col("shape").alias("b"))
    return steps.join(a, ["k", "rpm"]).join(b, ["k", "rpm2"]).select("k", "step", "rpm", "rpm2", "i", "j", mac(F.col("a"), F.col("b")).alias("mac"))


def tracked(shapes: DataFrame) -> DataFrame:
    """W1 from shapes (as in :func:`mac_neighbours`): what ``track(mac_neighbours(shapes))`` returns, without rows of pairs.

    A harmonic's shapes go to one task, which holds them and a bounded number of candidates a
    track. Shapes without all their parts have a MAC of 0 with any other.
    """

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray([] if s is None else s, float) for s in rows["shape"]]
        table = np.full((len(parts), max(map(len, parts), default=0)), np.nan)
        for own, part in zip(table, parts, strict=True):
            own[: len(part)] = part
        rpm, modes = rows["rpm"].to_numpy(), rows["mode_idx"].to_numpy()
        out, held, last, speeds = [], None, None, np.unique(rpm)
        for speed in speeds[: len(speeds) if len(speeds) > 1 else 0]:
            own = rpm == speed
            at = np.zeros((int(modes[own].max()) + 1, table.shape[1]))
            at[modes[own]] = table[own]
            if held is None:
                held = np.arange(len(at))
            else:
                before = held[: len(last)]
                now = np.where((before >= 0)[:, None], last[before], 0.0)
                held = np.full(len(held), -1)
                for t, j in tracking.assigned(np.arange(len(before)), now, at).items():
                    held[t] = j
            last = at
            out.append(pd.DataFrame({"k": key[0], "rpm": speed, "track": np.arange(len(held)), "mode_idx": held}))
        return pd.concat(out) if out else pd.DataFrame(columns=["k", "rpm", "track", "mode_idx"])

    whole = shapes.where("k is not null and rpm is not null").select("k", "rpm", "mode_idx", "shape")
    return whole.groupBy("k").applyInPandas(follow, "k int, rpm double, track int, mode_idx int")
