"""Whole studies composed of operators: forced response, mode names, Campbell and ZZENF data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.pairs import squared
from . import modal, response


def forced_response(modes: DataFrame, shapes: DataFrame, force: DataFrame, eo: int, sectors: int, zeta: Column, points: int, low: float = 0.0, high: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(peaks, sweep) of the modes (k, mode_idx, freq_hz) that an engine order excites.

    J8 picks harmonics, A7 the modal forces of shapes (k, mode_idx, node_id, d, re, im), P14 the
    response over ``points`` frequencies from ``low`` to ``high``; where these aren't positive,
    A18 sets them from the excited modes. A mode without a shape has the force 1. No excited
    mode gives empty tables (A29).
    """
    own = modes.where(physics.excites(F.lit(eo), F.col("k"), sectors))
    forces = response.modal_forces(shapes, force, ["k", "mode_idx"])
    loaded = own.join(forces, ["k", "mode_idx"], "left").withColumn("q_re", F.coalesce("q_re", F.lit(1.0))).withColumn("q_im", F.coalesce("q_im", F.lit(0.0)))
    ends = response.auto_range(own).select(*[F.lit(v).alias(n) if v > 0 else n for n, v in (("low", float(low)), ("high", float(high)))])
    swept = response.frf(loaded.crossJoin(F.broadcast(ends)).withColumn("damping", zeta), points, F.col("damping"), F.col("low"), F.col("high")).drop("low", "high")
    size = F.sqrt(squared((F.col("h_re"), F.col("h_im"))))
    best = F.max(F.struct(size.alias("m"), (-F.col("f_hz")).alias("f"))).alias("b")
    peaks = swept.groupBy("k", "mode_idx", "freq_hz", "q_re", "q_im").agg(best, F.first("damping").alias("zeta"))
    return peaks.select("k", "mode_idx", "freq_hz", "q_re", "q_im", "zeta", F.col("b.m").alias("max_amplitude"), F.when(F.col("b.m") > 0, -F.col("b.f")).otherwise(F.col("freq_hz")).alias("resonance_hz")), swept


def excited_count(modes: DataFrame, eo: int, sectors: int) -> DataFrame:
    """How many modes an engine order excites, as one row."""
    return modes.where(physics.excites(F.lit(eo), F.col("k"), sectors)).agg(F.count("*").alias("modes"))


def in_phase(samples: DataFrame, keys: list[str], line: str | None = None) -> DataFrame:
    """Complex samples (re, im) turned by the phase of the largest one of each group; the real part is ``value``."""
    w = Window.partitionBy(*keys, *([line] if line else []))
    size = squared((F.col("re"), F.col("im")))
    top = F.max_by(F.struct("re", "im"), size).over(w)
    norm = F.sqrt(squared((F.col("t.re"), F.col("t.im"))))
    value = F.when(norm > 0, (F.col("re") * F.col("t.re") + F.col("im") * F.col("t.im")) / norm).otherwise(0.0)
    return samples.withColumn("t", top).withColumn("value", value).drop("t")


def identify_modes(shapes: DataFrame, nodes: DataFrame, modes: DataFrame, radius: float) -> DataFrame:
    """Family, nodal circles, wave velocity and label of each mode.

    ``shapes``: mode, node_id and complex displacement ux_re to uz_im; ``modes``: mode, k, freq_hz.
    Displacements turn to radial, tangential and axial parts (P20); RMS shares give the family
    (A8), the axial part in phase gives the circles (W11); the label is circles + 1 and family.
    """
    s = shapes.join(nodes, "node_id")
    parts = {}
    for p in ("re", "im"):
        r, ur, ut = physics.cylindrical(F.col("x"), F.col("y"), F.col(f"ux_{p}"), F.col(f"uy_{p}"))
        parts[p] = (F.coalesce(ur, F.lit(0.0)), F.coalesce(ut, F.lit(0.0)))
    squares = [(parts["re"][i] * parts["re"][i] + parts["im"][i] * parts["im"][i]).alias(n) for i, n in enumerate(("ur2", "ut2"))]
    family = response.family_class(s.select("mode", *squares, squared((F.col("uz_re"), F.col("uz_im"))).alias("ua2")), ["mode"]).select("mode", "family")
    flat = s.select("mode", F.hypot("x", "y").alias("r"), F.atan2("y", "x").alias("theta"), F.col("uz_re").alias("re"), F.col("uz_im").alias("im"))
    circles = response.nodal_circles(in_phase(flat, ["mode"]).select("mode", "r", "theta", "value"))
    out = modes.join(family, "mode").join(circles, "mode", "left").withColumn("circles", F.coalesce("circles", F.lit(0)))
    velocity = physics.wave_velocity(F.col("freq_hz"), F.col("k"), radius)
    return out.withColumn("velocity", velocity).withColumn("label", F.concat((F.col("circles") + 1).cast("string"), "family"))


def campbell_study(modes: DataFrame, orders: DataFrame, sectors: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, crossings, order lines) of a Campbell diagram.

    Modes (rpm, k, mode_idx, freq_hz, whirl) go to the stationary frame (U1); a line is a family
    of a harmonic, with the whirl that most of its points have (A27); W2 finds crossings.
    """
    lines = modal.campbell(modes, sectors).select("rpm", "k", F.col("family").alias("mode_idx"), "freq_hz", "whirl")
    lines = lines.join(modal.dominant_whirl(lines), ["k", "mode_idx"])
    top = lines.agg(F.max("freq_hz")).first()[0] or 0.0
    return lines, modal.crossings(lines, orders), modal.order_lines(modes.select("rpm").distinct(), orders, top)


def passing_lines(rpms: DataFrame, vanes: DataFrame, top: float) -> DataFrame:
    """Lines ``n * vanes * rpm / 60`` for n from 1 while they stay below ``top`` Hz."""
    base = F.col("vanes") * F.col("rpm") / 60
    n = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(top / base).cast("int")))).alias("n")
    rows = rpms.where("rpm > 0").crossJoin(vanes).select("rpm", "vanes", n)
    return rows.withColumn("line_hz", F.col("n") * base).where(F.col("line_hz") <= top)


def zzenf_lines(points: DataFrame, sectors: int, degenerate_only: bool = False) -> DataFrame:
    """Forward and backward lines (direction, family, nd, freq_hz) of points with a whirl.

    Standing points (whirl 0) anchor both lines, unless only degenerate diameters count; W7
    keeps the lowest point of each diameter.
    """
    sides = []
    for whirl, name in ((1, "FW"), (-1, "BW")):
        own = points.where(physics.degenerate(F.col("nd"), sectors)).where(F.col("whirl") == whirl) if degenerate_only else points.where(F.col("whirl").isin(0, whirl))
        sides.append(own.withColumn("direction", F.lit(name)))
    return sides[0].unionByName(sides[1]).groupBy("direction", "family", "nd").agg(F.min("freq_hz").alias("freq_hz"))


def label_points(points: DataFrame) -> DataFrame:
    """The point of each family with the largest diameter, then frequency."""
    return points.groupBy("family").agg(F.max(F.struct("nd", "freq_hz")).alias("p")).select("family", "p.nd", "p.freq_hz")


def with_band(points: DataFrame, upper: DataFrame, lower: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the bounds (keys, at, bound) of their band, for keys whose bounds are equally many."""
    sizes = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    paired = sizes(upper, "u").join(sizes(lower, "l"), keys).where("u = l").select(*keys)
    rank = Window.partitionBy(*keys).orderBy("at", "bound")
    place = lambda df, n: df.join(paired, keys, "left_semi").withColumn("place", F.row_number().over(rank)).select(*keys, "place", F.col("at").alias(f"{n}_at"), F.col("bound").alias(n))
    band = place(upper, "upper").join(place(lower, "lower"), [*keys, "place"])
    return points.join(band.select(*keys, F.col("upper_at").alias("at"), "upper", "lower"), [*keys, "at"], "left")


def zigzag_crossings(lines: DataFrame, zigzag: DataFrame, rpm: float) -> DataFrame:
    """Where family lines (direction, family, nd, freq_hz) cross the folded excitation line of
    one speed between neighbouring diameters: (direction, family, nd, cross_nd, cross_hz)."""
    step = Window.partitionBy("direction", "family").orderBy("nd")
    pairs = lines.withColumn("nd2", F.lead("nd").over(step)).withColumn("freq2", F.lead("freq_hz").over(step)).where("nd2 = nd + 1")
    line = zigzag.where(F.col("rpm") == rpm).select("e", F.col("nd").alias("nd"), "line_hz")
    after = Window.orderBy("e").partitionBy(F.lit(0))
    steps = line.withColumn("znd2", F.lead("nd").over(after)).withColumn("line2", F.lead("line_hz").over(after)).where("abs(znd2 - nd) = 1")
    rising = steps.select(F.least("nd", "znd2").alias("nd"), F.when(F.col("znd2") > F.col("nd"), F.col("line_hz")).otherwise(F.col("line2")).alias("a"), F.when(F.col("znd2") > F.col("nd"), F.col("line2")).otherwise(F.col("line_hz")).alias("b"))
    d1, d2 = F.col("freq_hz") - F.col("a"), F.col("freq2") - F.col("b")
    share = F.abs("d1") / (F.abs("d1") + F.abs("d2"))
    out = pairs.join(rising, "nd").withColumn("d1", d1).withColumn("d2", d2).where("d1 * d2 < 0")
    return out.select("direction", "family", "nd", (F.col("nd") + share).alias("cross_nd"), (F.col("freq_hz") + share * (F.col("freq2") - F.col("freq_hz"))).alias("cross_hz"))


def modal_mass(shapes: DataFrame, mass: DataFrame, keys: list[str], sectors: int) -> DataFrame:
    """``N Re(phi^H M phi)`` of shapes (keys, dof, re, im) and a matrix of entries (row, col, val)."""
    a = shapes.select(*keys, F.col("dof").alias("row"), F.col("re").alias("a_re"), F.col("im").alias("a_im"))
    b = shapes.select(*keys, F.col("dof").alias("col"), F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    product = (F.col("a_re") * F.col("b_re") + F.col("a_im") * F.col("b_im")) * F.col("val")
    return a.join(mass.select("row", "col", "val"), "row").join(b, [*keys, "col"]).groupBy(*keys).agg((F.sum(product) * sectors).alias("modal_mass"))


def mass_factors(shapes: DataFrame, mass: DataFrame, direction: DataFrame, keys: list[str]) -> DataFrame:
    """``abs(phi^T M D)`` for a full matrix and a direction (dof, val)."""
    load = mass.join(direction.select(F.col("dof").alias("col"), F.col("val").alias("d")), "col").groupBy(F.col("row").alias("dof")).agg(F.sum(F.col("val") * F.col("d")).alias("md"))
    sums = shapes.join(load, "dof").groupBy(*keys).agg(F.sum(F.col("re") * F.col("md")).alias("re"), F.sum(F.col("im") * F.col("md")).alias("im"))
    return sums.select(*keys, F.sqrt(squared((F.col("re"), F.col("im")))).alias("gamma"))


def harmonic_table(modes: DataFrame) -> DataFrame:
    """Harmonics in order, with the place of each in a list and its number of modes."""
    sizes = modes.groupBy("k").agg(F.count("*").alias("modes"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")) - 1)


def suspicious(modes: DataFrame, norm: Column | None = None) -> DataFrame:
    """per harmonic, counts of frequencies that are no number or negative, and of shapes without a norm."""
    none = F.lit(False) if norm is None else norm < 1e-15
    return modes.groupBy("k").agg(F.count_if(F.isnan("freq_hz")).alias("not_numbers"), F.count_if(~F.isnan("freq_hz") & (F.col("freq_hz") < 0)).alias("negative"), F.count_if(none).alias("no_norm"))


def diagnostic_text(stats: DataFrame, rel: DataFrame, families: int) -> DataFrame:
    """The summary of a frequency diagnosis as one row, line by line in order of diameters."""
    line = F.format_string("  ND %2d: mean=%.4f%%  max=%.4f%%  std=%.4f%%  (%d modes)", F.col("nd").cast("int"), "mean_err", "max_err", "std_err", "n_modes")
    lines = stats.agg(F.array_sort(F.collect_list(F.struct("nd", line.alias("line")))).alias("ls"), F.count("*").alias("n"))
    w, all_ = response.worst(rel), rel.agg(F.coalesce(F.avg("rel"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("rel"), F.lit(0.0)).alias("most"))
    one = lines.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(w.select(F.col("nd").alias("wn"), F.col("j").alias("wj"), F.col("rel").alias("wr"))))
    head = F.array(
        F.format_string(f"Frequency Diagnostic Summary (%d NDs x {families} modes)", "n"), F.format_string("  Mean relative error:  %.4f%%", "mean"), F.format_string("  Max  relative error:  %.4f%%", "most"),
        F.format_string("  Worst mode: ND=%d, mode=%d (%.4f%%)", F.col("wn").cast("int"), F.col("wj").cast("int"), "wr"),
    )
    return one.select(F.array_join(F.concat(head, F.transform("ls", lambda x: x["line"])), "\n").alias("summary"))
