"""Quadrature, scaling bases, two-scale filters and the dense block arithmetic of nodes (numpy).

A node's coefficients are 2^D blocks of (k+1)^D numbers. In a batch they are rows; seen as an array of
shape (rows, 2, .., 2, K, .., K) the last block axis and the last inner axis belong to x.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.polynomial import legendre


@lru_cache(maxsize=None)
def quadrature(points: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on [0, 1]."""
    x, w = legendre.leggauss(points)
    return (x + 1) / 2, w / 2


def legendre_values(k: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal Legendre polynomials on [0, 1]: (len(x), k + 1)."""
    return legendre.legvander(2 * np.asarray(x, float) - 1, k) * np.sqrt(2 * np.arange(k + 1) + 1)


@lru_cache(maxsize=None)
def to_legendre(k: int, basis: str) -> np.ndarray:
    """Rows: the basis functions in orthonormal Legendre polynomials."""
    if basis == "legendre":
        return np.eye(k + 1)
    x, w = quadrature(k + 1)
    return legendre_values(k, x) * np.sqrt(w)[:, None]


def scaling_values(k: int, basis: str, x: np.ndarray) -> np.ndarray:
    """Values of the k + 1 scaling functions on [0, 1]: (len(x), k + 1)."""
    return legendre_values(k, x) @ to_legendre(k, basis).T


def _two_scale(k: int, basis: str) -> np.ndarray:
    """[H0 H1] times sqrt(2)."""
    x, w = quadrature(k + 1)
    inner = scaling_values(k, basis, x)
    return np.hstack([(scaling_values(k, basis, (x + c) / 2) * w[:, None]).T @ inner for c in (0, 1)])


@lru_cache(maxsize=None)
def filters(k: int, basis: str) -> np.ndarray:
    """The orthogonal 2K x 2K matrix [[H0 H1], [G0 G1]] that turns two children's scaling coefficients into the
    parent's scaling and wavelet ones. H follows from the two-scale relation; G completes it orthogonally."""
    h = _two_scale(k, basis) / np.sqrt(2)
    q, r = np.linalg.qr(h.T, mode="complete")
    g = q[:, k + 1 :].T
    # a sign for each row, so that the same numbers come out everywhere
    big = np.abs(g).argmax(1)
    g = g * np.sign(g[np.arange(k + 1), big])[:, None]
    return np.vstack([h, g])


@lru_cache(maxsize=None)
def whole_filters(k: int, basis: str) -> np.ndarray:
    """filters times sqrt(2): ones in H at order 0, which add up without rounding."""
    return np.vstack([_two_scale(k, basis), filters(k, basis)[k + 1 :] * np.sqrt(2)])


def _per_axis(a: np.ndarray, dim: int, k: int, m: np.ndarray) -> np.ndarray:
    """Applies m[(b, i), (c, j)] along each dimension's (block, inner) pair of axes."""
    n, K = len(a), k + 1
    a = a.reshape((n,) + (2,) * dim + (K,) * dim)
    t = m.reshape(2, K, 2, K)
    for d in range(dim):
        axes = (1 + dim - 1 - d, 1 + 2 * dim - 1 - d)
        a = np.moveaxis(np.tensordot(a, t, axes=(axes, (2, 3))), (-2, -1), axes)
    return a.reshape(n, -1)


def compress(a: np.ndarray, dim: int, k: int, basis: str, whole: bool = False) -> np.ndarray:
    """Children's scaling coefficients (block = child) to the node's scaling and wavelet blocks; whole: these times 2^(D/2)."""
    return _per_axis(a, dim, k, whole_filters(k, basis) if whole else filters(k, basis))


def reconstruct(a: np.ndarray, dim: int, k: int, basis: str) -> np.ndarray:
    """The node's blocks to its children's scaling coefficients."""
    return _per_axis(a, dim, k, filters(k, basis).T)


def _inner(a: np.ndarray, dim: int, m: np.ndarray) -> np.ndarray:
    """Applies m[i, j] along each inner axis of blocks (rows, K^dim)."""
    K = m.shape[1]
    a = a.reshape((len(a),) + (K,) * dim)
    for d in range(dim):
        a = np.moveaxis(np.tensordot(a, m, axes=((1 + d,), (1,))), -1, 1 + d)
    return a.reshape(len(a), -1)


def values_to_coefs(v: np.ndarray, dim: int, k: int, basis: str, scale: np.ndarray, volume: float = 1.0) -> np.ndarray:
    """Values at the quadrature points of cells of the given scales to their scaling coefficients."""
    x, w = quadrature(k + 1)
    m = (scaling_values(k, basis, x) * w[:, None]).T
    return _inner(v, dim, m) * np.sqrt(volume / 2.0 ** (dim * scale))[:, None]


def coefs_to_values(c: np.ndarray, dim: int, k: int, basis: str, scale: np.ndarray, volume: float = 1.0) -> np.ndarray:
    x, _ = quadrature(k + 1)
    return _inner(c, dim, scaling_values(k, basis, x)) * np.sqrt(2.0 ** (dim * scale) / volume)[:, None]


def lattice(dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Quadrature points (K^dim, dim) and weights of the unit cell, x fastest."""
    x, w = quadrature(k + 1)
    grid = np.meshgrid(*[x] * dim, indexing="ij")
    weight = np.ones(1)
    for _ in range(dim):
        weight = np.multiply.outer(weight, w).ravel()
    return np.stack([g.ravel() for g in grid][::-1], 1), weight


def child_steps(dim: int) -> np.ndarray:
    """(2^dim, dim): what child c adds to twice the parent's translation."""
    return (np.arange(1 << dim)[:, None] >> np.arange(dim)) & 1


def evaluate(coefs: np.ndarray, unit: np.ndarray, dim: int, k: int, basis: str, scale: np.ndarray, volume: float = 1.0) -> np.ndarray:
    """The function with these scaling blocks (rows, K^dim) at one point of the unit cell each (rows, dim)."""
    out = coefs.reshape((len(coefs),) + (k + 1,) * dim)
    for d in range(dim):  # the last axis is x
        out = np.einsum("...i,...i->...", out, scaling_values(k, basis, unit[:, d]).reshape((len(out),) + (1,) * (out.ndim - 2) + (k + 1,)))
    return out * np.sqrt(2.0 ** (dim * scale) / volume)


def integral_weights(dim: int, k: int, basis: str) -> np.ndarray:
    """Integrals of the scaling functions over the unit cell."""
    x, w = quadrature(k + 1)
    one = (scaling_values(k, basis, x) * w[:, None]).sum(0)
    out = np.ones(1)
    for _ in range(dim):
        out = np.multiply.outer(out, one).ravel()
    return out
