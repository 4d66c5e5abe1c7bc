"""Scalar formulas as column expressions (ids as in the survey)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pairs import Pair, over, squared

TWO_PI = 2 * math.pi
#: Added-mass factors for 0 to 10 nodal diameters.
KWAK_GAMMA = (0.6526, 0.3910, 0.2737, 0.2078, 0.1660, 0.1372, 0.1163, 0.1003, 0.0878, 0.0777, 0.0695)


def hertz(squared_omega: Column) -> Column:
    """Frequency of an eigenvalue; 0 unless it is positive."""
    return F.when(squared_omega > 0, F.sqrt(squared_omega) / TWO_PI).otherwise(0.0)


def angular(rpm: Column) -> Column:
    return rpm * (TWO_PI / 60)


def constitutive(e: Column, nu: Column) -> Column:
    """The isotropic 6 x 6 matrix, row by row."""
    c = e / ((1 + nu) * (1 - 2 * nu))
    rows = [[(1 - nu) if i == j else nu if i < 3 and j < 3 else F.lit(0.0) for j in range(6)] for i in range(6)]
    for i in range(3, 6):
        rows[i][i] = (1 - 2 * nu) / 2
    return F.array(*[F.array(*[c * x for x in row]) for row in rows])


def scaled_modulus(e: Column, slope: Column, temperature: Column, reference: Column) -> Column:
    """Young's modulus at a temperature; an error if it isn't positive."""
    out = e + slope * (temperature - reference)
    return F.when(out > 0, out).otherwise(F.raise_error(F.lit("modulus is not positive")).cast("double"))


def valid_material(e: Column, nu: Column, rho: Column) -> Column:
    """P3."""
    return (e > 0) & (nu > 0) & (nu < 0.5) & (rho > 0)


def wave_velocity(freq: Column, k: Column, radius: float) -> Column:
    """P8."""
    return F.when(k > 0, TWO_PI * freq * radius / k).otherwise(0.0)


def damping(kind: Column, ratios: Column, alpha: Column, beta: Column, mode: Column, omega: Column, aero: Column | None = None) -> Column:
    """P10: effective ratio of mode ``mode`` (from 0): the last given ratio serves beyond the list."""
    at = lambda a: F.when(F.size(a) > 0, F.element_at(a, F.least(mode + 1, F.size(a)))).otherwise(0.0)
    base = F.when(kind == "MODAL", at(ratios)).when((kind == "RAYLEIGH") & (omega > 0), alpha / (2 * omega) + beta * omega / 2).otherwise(0.0)
    return base + (at(aero) if aero is not None else 0.0)


def kwak_gamma(n: Column) -> Column:
    """Tabulated up to 10 nodal diameters, then a power law; negative ones are an error."""
    table = F.array(*map(F.lit, KWAK_GAMMA))
    return F.when(n < 0, F.raise_error(F.lit("negative nodal diameter")).cast("double")).when(n <= 10, F.element_at(table, n.cast("int") + 1)).otherwise(0.65 / F.pow(n + 0.05, 0.85))


def added_mass_ratio(n: Column, fluid: Column, solid: Column, radius: Column, thickness: Column) -> Column:
    """Frequency in fluid over frequency in vacuum."""
    return 1 / F.sqrt(1 + kwak_gamma(n) * (fluid / solid) * (radius / thickness))


def corrected(freq: Column, ratio: Column) -> Column:
    """Only ratios strictly between 0 and 1 apply."""
    return F.when((ratio > 0) & (ratio < 1), freq * ratio).otherwise(freq)


def modal_frf(q: Pair, omega_r: Column, omega: Column, zeta: Column) -> Pair:
    """Response of one mode; a vanishing denominator gives Q * 1e30."""
    den = (omega_r * omega_r - omega * omega, 2 * zeta * omega_r * omega)
    re, im = over(q, den)
    tiny = squared(den) < 1e-60
    return F.when(tiny, q[0] * 1e30).otherwise(re), F.when(tiny, q[1] * 1e30).otherwise(im)


def excites(eo: Column, k: Column, n: int) -> Column:
    """whether an engine order excites harmonic k of n sectors; never without sectors."""
    if n <= 0:
        return F.lit(False)
    r = F.pmod(eo, F.lit(n))
    return (r == F.pmod(k, F.lit(n))) | (r == F.pmod(-k, F.lit(n)))


def folded(order: Column, n: int) -> Column:
    """The harmonic, from 0 to n // 2, that an order aliases to."""
    r = F.pmod(order, F.lit(n))
    return F.least(r, n - r)


def degenerate(k: Column, n: int) -> Column:
    """F17."""
    return (k > 0) & (k < n // 2) | (F.lit(n % 2 == 1) & (k == n // 2) & (k > 0))


def cylindrical(p1: Column, p2: Column, d1: Column, d2: Column) -> tuple[Column, Column, Column]:
    """P20: radius, radial and tangential parts of a vector at (p1, p2); null on the axis."""
    r = F.sqrt(p1 * p1 + p2 * p2)
    off = r >= 1e-10
    return r, F.when(off, (p1 * d1 + p2 * d2) / r), F.when(off, (p1 * d2 - p2 * d1) / r)


def corrected_mass(val: Column, n: Column, fluid: Column, solid: Column, radius: Column, thickness: Column) -> Column:
    """An entry of the mass matrix with the fluid's share."""
    return val * (1 + kwak_gamma(n) * (fluid / solid) * (radius / thickness))


def rotation(axis: str, angle: float) -> list[list[float]]:
    """The matrix of a turn about an axis."""
    c, s = math.cos(angle), math.sin(angle)
    i, j, k = {"z": (0, 1, 2), "x": (1, 2, 0), "y": (2, 0, 1)}[axis]
    out = [[0.0] * 3 for _ in range(3)]
    out[i][i], out[i][j], out[j][i], out[j][j], out[k][k] = c, -s, s, c, 1.0
    return out


def rotation_4x4(axis: str, angle: float) -> list[float]:
    """The same as a flat homogeneous matrix, row by row."""
    return [*(v for row in rotation(axis, angle) for v in (*row, 0.0)), 0.0, 0.0, 0.0, 1.0]


def aligned(axis: str) -> list[Column]:
    """Columns x, y, z with ``axis`` moved to z by a cyclic exchange."""
    order = {"x": "yzx", "y": "zxy", "z": "xyz"}[axis]
    return [F.col(c).alias(to) for c, to in zip(order, "xyz", strict=True)]


def component(name: str, parts: dict[str, Pair]) -> Column:
    """What a picture of a mode shows of complex displacements, by axis."""
    if name in parts:
        return parts[name][0]
    total = lambda i: F.sqrt(sum((p[i] * p[i] for p in parts.values()), F.lit(0.0)))
    if name == "magnitude":
        return F.sqrt(sum((squared(p) for p in parts.values()), F.lit(0.0)))
    if name in ("real", "imag"):
        return total(0 if name == "real" else 1)
    raise ValueError(f"unknown component {name}")


def condition_label(temperature: Column) -> Column:
    """A condition's annotation; empty at the default temperature."""
    return F.when(temperature != 293.15, F.format_string("T=%.0fK", temperature)).otherwise("")


def harmonic_bytes(n: Column, modes: int, complex_entries: bool = True) -> Column:
    """Memory of one harmonic's solve: factor and Lanczos vectors."""
    width = 16 if complex_entries else 8
    return 800.0 * F.pow(n.cast("double"), F.lit(4.0 / 3.0)) + 2.0 * n * (F.least(F.lit(4 * modes + 1), n) + 1) * width


def target_dofs(free: int, modes: int, available: float) -> int:
    """The most degrees of freedom whose solve fits the memory, by Newton's method."""
    vectors, n = 4 * modes + 1, (available / 800.0) ** 0.75
    for _ in range(10):
        held = min(float(vectors), n)
        slope = 800.0 * 4.0 / 3.0 * n ** (1.0 / 3.0) + 32.0 * held
        new = n - (800.0 * n ** (4.0 / 3.0) + 32.0 * n * held - available) / slope
        if new < 1.0:
            return 1
        done, n = abs(new - n) < 1.0, new
        if done:
            break
    return max(1, min(math.floor(n), free))
