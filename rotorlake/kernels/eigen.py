"""Eigenproblems of one condition and harmonic, as arrays."""

from __future__ import annotations

import numpy as np


#: Up to this size a problem is reduced and solved whole.
DENSE = 200


def hermitian(k: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L1, L2: the n lowest pairs of K x = w2 M x, M-orthonormal, and relative residuals.

    Small problems, and those that want a large part of their pairs, are reduced by the
    Cholesky factor of M to a standard one; the others go to :func:`lanczos`.
    """
    k, m = (k + k.conj().T) / 2, (m + m.conj().T) / 2
    values, x = dense(k, m, n) if len(k) <= DENSE or 8 * n > len(k) else lanczos(k, m, n)
    kx = k @ x
    return values, x, np.linalg.norm(kx - (m @ x) * values, axis=0) / np.maximum(np.linalg.norm(kx, axis=0), 1e-300)


def dense(k: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.linalg.cholesky(m)
    values, vectors = np.linalg.eigh(np.linalg.solve(low, np.linalg.solve(low, k).conj().T))
    return values[:n], np.linalg.solve(low.conj().T, vectors[:, :n])


def lanczos(k: np.ndarray, m: np.ndarray, n: int, shift: float = -1.0, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The n lowest pairs by Lanczos on blocks of (K - shift M)^-1 M.

    Values above ``shift`` come lowest first. Where one below it shows, as in a sector that
    its speed makes unstable, the dense solver takes over.

    The basis is M-orthonormal and fully reorthogonalised, twice; a block of n + 4 vectors
    finds equal values at once. It grows by blocks until the n residuals are small or the
    basis spans everything.
    """
    size, width = len(k), min(len(k), n + 4)
    inverse = np.linalg.inv(k - shift * m)
    block = np.random.default_rng(0).normal(size=(size, width)).astype(k.dtype)
    basis, product = np.zeros((size, 0), k.dtype), np.zeros((size, 0), k.dtype)
    while True:
        for _ in range(2):
            block = block - basis @ (basis.conj().T @ (m @ block))
            grams = block.conj().T @ (m @ block)
            w, u = np.linalg.eigh((grams + grams.conj().T) / 2)
            keep = w > max(w[-1], 0.0) * 1e-14
            block = block @ (u[:, keep] / np.sqrt(w[keep]))
        basis = np.hstack([basis, block])
        after = inverse @ (m @ block)
        product = np.hstack([product, after])
        small = basis.conj().T @ (m @ product)
        theta, y = np.linalg.eigh((small + small.conj().T) / 2)
        best = np.argsort(-np.abs(theta), kind="stable")[:n]
        off = np.linalg.norm(product @ y[:, best] - (basis @ y[:, best]) * theta[best], axis=0)
        done = np.all(off <= tolerance * np.abs(theta[best]) * np.linalg.norm(basis @ y[:, best], axis=0))
        if theta[0] < -1e-9 * theta[-1]:
            return dense(k, m, n)
        if len(best) == n and done or basis.shape[1] + width > size or not block.shape[1]:
            if not done:
                return dense(k, m, n)
            values = shift + 1 / theta[best]
            order = np.argsort(values, kind="stable")
            return values[order], (basis @ y[:, best])[:, order]
        block = after


def quadratic(k: np.ndarray, d: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L3: roots of (K + w D - w2 M) x = 0, D Hermitian, by the symmetric linearisation of twice the size.

    With y = w x, [[D, K], [K, 0]] (y, x) = w [[M, 0], [0, K]] (y, x). Up to n forward and n
    backward roots by magnitude (T3): frequencies, whirl +1 or -1, shapes.
    """
    size, zero = len(k), np.zeros_like(k)
    left, right = np.block([[d, k], [k, zero]]), np.block([[m, zero], [zero, k]])
    values, vectors, _ = hermitian(left, right, 2 * size)
    keep = []
    for sign in (1, -1):
        own = np.flatnonzero((np.sign(values) == sign) & (np.abs(values) >= 1e-6))
        keep.append(own[np.argsort(np.abs(values[own]), kind="stable")][:n])
    chosen = np.concatenate(keep)
    chosen = chosen[np.argsort(np.abs(values[chosen]), kind="stable")]
    return np.abs(values[chosen]) / (2 * np.pi), np.sign(values[chosen]).astype(int), vectors[size:, chosen]


def condense(k: np.ndarray, m: np.ndarray, masters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Guyan condensation to ``masters``: reduced K and M, and the matrix back to all."""
    slaves = np.setdiff1d(np.arange(len(k)), masters)
    t = np.zeros((len(k), len(masters)), k.dtype)
    t[masters, np.arange(len(masters))] = 1
    if len(slaves):
        t[slaves] = -np.linalg.solve(k[np.ix_(slaves, slaves)], k[np.ix_(slaves, masters)])
    return t.conj().T @ k @ t, t.conj().T @ m @ t, t
