"""Quadratic tetrahedra (10 nodes): shape functions and element matrices, many at once."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Local corner pairs of the six edge nodes.
EDGES = ((0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3))


def shape(points: np.ndarray) -> np.ndarray:
    """Values of the 10 functions at points (x, y, z) of the reference element."""
    l = np.column_stack([1 - points.sum(axis=1), points])  # noqa: E741
    return np.column_stack([l * (2 * l - 1), *[4 * l[:, a] * l[:, b] for a, b in EDGES]])


def slope(points: np.ndarray) -> np.ndarray:
    """Derivatives (points, 10, 3)."""
    l = np.column_stack([1 - points.sum(axis=1), points])  # noqa: E741
    dl = np.vstack([-np.ones(3), np.eye(3)])
    corners = (4 * l - 1)[:, :, None] * dl[None]
    edges = np.stack([4 * (l[:, a, None] * dl[b] + l[:, b, None] * dl[a]) for a, b in EDGES], axis=1)
    return np.concatenate([corners, edges], axis=1)


@cache
def rule(n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that integrate polynomials of degree 2n - 1 over the reference element.

    A Gauss-Legendre rule on the cube, collapsed onto the tetrahedron.
    """
    x, w = np.polynomial.legendre.leggauss(n)
    x, w = (x + 1) / 2, w / 2
    a, b, c = (g.ravel() for g in np.meshgrid(x, x, x, indexing="ij"))
    wa, wb, wc = (g.ravel() for g in np.meshgrid(w, w, w, indexing="ij"))
    points = np.column_stack([a, b * (1 - a), c * (1 - a) * (1 - b)])
    return points, wa * wb * wc * (1 - a) ** 2 * (1 - b)


def stiffness_law(e: float, nu: float) -> np.ndarray:
    """P1 as an array."""
    d = np.zeros((6, 6))
    d[:3, :3] = nu
    d[np.arange(3), np.arange(3)] = 1 - nu
    d[np.arange(3, 6), np.arange(3, 6)] = (1 - 2 * nu) / 2
    return d * e / ((1 + nu) * (1 - 2 * nu))


def jacobians(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P5: derivatives in space (elements, points, 10, 3) and determinants; degenerate ones raise."""
    dn = slope(points)
    j = np.einsum("pni,enk->epik", dn, x)
    det = np.linalg.det(j)
    if (np.abs(det) < 1e-30).any():
        raise ValueError("an element has no volume")
    return np.einsum("epik,pnk->epni", np.linalg.inv(j), dn), det


def strain(grad: np.ndarray) -> np.ndarray:
    """P5: strain-displacement matrices (..., 6, 30)."""
    b = np.zeros((*grad.shape[:-2], 6, 30))
    for i in range(3):
        b[..., i, i::3] = grad[..., i]
    for row, (i, k) in enumerate(((0, 1), (1, 2), (0, 2)), start=3):
        b[..., row, i::3], b[..., row, k::3] = grad[..., k], grad[..., i]
    return b


def matrices(x: np.ndarray, e: float, nu: float, rho: float, axis: str = "z") -> dict[str, np.ndarray]:
    """Per element, stiffness and mass, and for unit speed about ``axis`` spin softening,
    gyroscopic matrix and centrifugal force. ``x``: (elements, 10, 3)."""
    points, weights = rule()
    grad, det = jacobians(x, points)
    n, scale = shape(points), np.abs(det) * weights
    b = strain(grad)
    k = np.einsum("epai,ab,epbj,ep->eij", b, stiffness_law(e, nu), b, scale, optimize=True)
    nn = rho * np.einsum("pn,pm,ep->enm", n, n, scale, optimize=True)
    spread = lambda block: np.einsum("enm,ij->enimj", nn, block).reshape(len(x), 30, 30)
    at = np.einsum("pn,enk->epk", n, x)
    a = np.eye(3)["xyz".index(axis)]
    across = np.eye(3) - np.outer(a, a)
    force = rho * np.einsum("pn,epk,ep->enk", n, at @ across, scale, optimize=True)
    turn = np.cross(a, np.eye(3)).T
    return {"K": k, "M": spread(np.eye(3)), "K_omega": spread(across), "G": spread(turn), "F": force.reshape(len(x), 30)}


def stress_stiffness(x: np.ndarray, u: np.ndarray, e: float, nu: float) -> np.ndarray:
    """Geometric stiffness (elements, 30, 30) of the stress that displacements ``u`` (elements, 30) cause."""
    points, weights = rule()
    grad, det = jacobians(x, points)
    s = np.einsum("ab,epbi,ei->epa", stiffness_law(e, nu), strain(grad), u, optimize=True)
    stress = np.stack([np.stack([s[..., 0], s[..., 3], s[..., 5]], -1), np.stack([s[..., 3], s[..., 1], s[..., 4]], -1), np.stack([s[..., 5], s[..., 4], s[..., 2]], -1)], -2)
    block = np.einsum("epni,epij,epmj,ep->enm", grad, stress, grad, np.abs(det) * weights, optimize=True)
    return np.einsum("enm,ij->enimj", block, np.eye(3)).reshape(len(x), 30, 30)


def negative(x: np.ndarray) -> np.ndarray:
    """elements with a determinant that isn't positive at one of four Gauss points."""
    a, b = (5 - np.sqrt(5)) / 20, (5 + 3 * np.sqrt(5)) / 20
    points = np.full((4, 3), a)
    points[np.arange(1, 4), np.arange(3)] = b
    return (np.linalg.det(np.einsum("pni,enk->epik", slope(points), x)) <= 0).any(axis=1)


def untangled(x: np.ndarray, steps: int = 10) -> np.ndarray:
    """Per element, the smallest blend of its edge nodes towards the edges' middles (by
    bisection, from 0 to 1) that makes every determinant positive; NaN if none does."""
    middle = x.copy()
    for n, (i, j) in enumerate(EDGES, start=4):
        middle[:, n] = (x[:, i] + x[:, j]) / 2
    bad, hopeless = negative(x), negative(middle)
    low, high = np.zeros(len(x)), np.ones(len(x))
    for _ in range(steps):
        mid = (low + high) / 2
        still = negative(x + mid[:, None, None] * (middle - x))
        low, high = np.where(still, mid, low), np.where(still, high, mid)
    return np.where(bad, np.where(hopeless, np.nan, high), 0.0)
