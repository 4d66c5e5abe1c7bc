"""Potential flow around a body of revolution: elliptic integrals, ring sources, added mass."""

from __future__ import annotations

import numpy as np


def elliptic(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Complete integrals K and E of modulus k in [0, 1) by the arithmetic-geometric mean."""
    k = np.asarray(k, float)
    if ((k < 0) | (k >= 1)).any():
        raise ValueError("the modulus must be in [0, 1)")
    a, b, c, power, total = np.ones_like(k), np.sqrt(1 - k * k), k.copy(), 0.5, 0.5 * k * k
    for _ in range(30):
        if (np.abs(c) < 1e-16).all():
            break
        a, b, c = (a + b) / 2, np.sqrt(a * b), (a - b) / 2
        power *= 2
        total = total + power * c * c
    first = np.pi / (2 * a)
    return first, first * (1 - total)


def around(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A Gauss-Legendre rule over a full turn, fine enough for n waves."""
    x, w = np.polynomial.legendre.leggauss(max(2 * n + 8, 24))
    return np.pi * (x + 1), np.pi * w


def ring(n: int, r: np.ndarray, z: np.ndarray, rs: np.ndarray, zs: np.ndarray, nr: np.ndarray, nz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Potential at (r, z) of a unit ring source of n waves at (rs, zs), over rs, and its slope
    along the source's normal. The slope is that of the potential with its factor rs, over rs."""
    t, w = around(n)
    r, z, rs, zs, nr, nz = (np.asarray(v, float)[..., None] for v in np.broadcast_arrays(r, z, rs, zs, nr, nz))
    dr, dz = rs - r * np.cos(t), zs - z
    d2 = np.maximum(r * r + rs * rs - 2 * r * rs * np.cos(t) + dz * dz, 1e-30)
    wave = w * np.cos(n * t) / (4 * np.pi)
    slope = (nr / (np.maximum(rs, 1e-30) * np.sqrt(d2)) - (dr * nr + dz * nz) / d2**1.5) * wave
    if n == 0:
        far2 = (r + rs) ** 2 + dz * dz
        modulus = np.sqrt(np.clip(4 * r * rs / np.maximum(far2, 1e-30), 0, 1 - 1e-15))[..., 0]
        return elliptic(modulus)[0] / (np.pi * np.sqrt(np.maximum(far2[..., 0], 1e-30))), slope.sum(-1)
    return (wave / np.sqrt(d2)).sum(-1), slope.sum(-1)


def own(n: int, r: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The self term of a panel: analytic for n = 0, the potential at its middle otherwise."""
    if n == 0:
        return length / (2 * np.pi) * (1 + np.log(8 * np.maximum(r, 1e-12) / length))
    t, w = around(n)
    away = np.sqrt(2 * (1 - np.cos(t)))
    return length * (w * np.cos(n * t) / np.maximum(away, 1e-12)).sum() / (4 * np.pi)


def added_mass(n: int, panels: dict[str, np.ndarray], rho: float) -> np.ndarray:
    """The added-mass matrix over panels (r_mid, z_mid, nr, nz, len) for n waves.

    Solves (I/2 + H) X = G for the potential of a unit normal velocity on each panel.
    """
    r, z, nr, nz, size = (np.asarray(panels[c], float) for c in ("r_mid", "z_mid", "nr", "nz", "len"))
    g, h = ring(n, r[:, None], z[:, None], r, z, nr, nz)
    g, h = g * r * size, h * r * size
    g[np.arange(len(r)), np.arange(len(r))] = own(n, r, size)
    h[np.arange(len(r)), np.arange(len(r))] = 0.0
    x = np.linalg.solve(np.eye(len(r)) / 2 + h, g)
    m = rho * (2 * np.pi * r * size)[:, None] * x
    return (m + m.T) / 2
