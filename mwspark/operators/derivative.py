"""Derivatives of trees by K x K blocks between a cell and its neighbours of the same scale.

weak_blocks: the weak multiwavelet derivative with boundary weights (a, b). low_noise_blocks: smooth differences of points
about each quadrature point. spline_blocks: the derivative of the spline that fits three cells best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mwspark.functions import basis as B
from mwspark.functions.shared import write_shared
from mwspark.functions.trees import NODE, keys_of, map_coefs
from mwspark.mra import AXES, MRA, TREE_KEY
from mwspark.operators import arith
from mwspark.operators.grid import closure
from mwspark.operators.keys import end_nodes, root_of_node, wrap_index
from mwspark.operators.transform import rebuild


def weak_blocks(k: int, basis: str, a: float, b: float) -> dict[int, np.ndarray]:
    """K x K blocks by neighbour -1, 0, 1: boundary values weighted by a (right) and b (left) minus the integral of phi_i' phi_j."""
    x, w = B.quadrature(k + 1)
    v = B.scaling_values(k, basis, x)
    ends = B.scaling_values(k, basis, np.array([0.0, 1.0]))
    t = np.polynomial.legendre.legvander(2 * x - 1, k)
    # derivatives of the orthonormal Legendre polynomials at the points
    d = np.stack([np.polynomial.legendre.legval(2 * x - 1, np.polynomial.legendre.legder(np.eye(k + 1)[j])) if j else np.zeros_like(x) for j in range(k + 1)], 1)
    d = 2 * d * np.sqrt(2 * np.arange(k + 1) + 1) @ B.to_legendre(k, basis).T
    assert t.shape == v.shape
    weak = (d * w[:, None]).T @ v
    lo, hi = ends[0], ends[1]
    return {
        0: (1 - a) * np.outer(hi, hi) - (1 - b) * np.outer(lo, lo) - weak,
        1: a * np.outer(hi, lo),
        -1: -b * np.outer(lo, hi),
    }


# fixed values: weights of smooth low-noise differences at 1, 2, 3 steps to either side, and their divisor
LOW_NOISE = {1: ((5.0, 4.0, 1.0), 32.0), 2: ((-1.0, 2.0, 1.0), 16.0)}
NOISE_STEP = 0.02  # of a cell


def _values_of_three(k: int, basis: str, at: np.ndarray) -> np.ndarray:
    """(len(at), 3K): values at points of [-1, 2) of functions given by their coefficients in the cells -1, 0 and 1."""
    cell = np.clip(np.floor(at).astype(int), -1, 1)
    v = B.scaling_values(k, basis, at - cell)
    out = np.zeros((len(at), 3, k + 1))
    out[np.arange(len(at)), cell + 1] = v
    return out.reshape(len(at), -1)


def _blocks_from_values(k: int, basis: str, of_coefs: np.ndarray) -> dict[int, np.ndarray]:
    """Blocks from the matrix that takes the 3K coefficients to the derivative at the K quadrature points of cell 0."""
    x, w = B.quadrature(k + 1)
    m = (B.scaling_values(k, basis, x) * w[:, None]).T @ of_coefs
    return {c: m[:, (c + 1) * (k + 1) : (c + 2) * (k + 1)] for c in (-1, 0, 1)}


def low_noise_blocks(k: int, basis: str, order: int = 1, step: float = NOISE_STEP) -> dict[int, np.ndarray]:
    """First or second derivative by smooth low-noise differences."""
    x, _ = B.quadrature(k + 1)
    weights, divisor = LOW_NOISE[order]
    total = 0 if order == 1 else -2 * sum(weights) * _values_of_three(k, basis, x)
    for i, c in enumerate(weights, 1):
        ahead, behind = _values_of_three(k, basis, x + i * step), _values_of_three(k, basis, x - i * step)
        total = total + c * (ahead - behind if order == 1 else ahead + behind)
    return _blocks_from_values(k, basis, total / divisor / step**order)


def _spline(knots: np.ndarray, degree: int, x: np.ndarray, order: int = 0) -> np.ndarray:
    """(len(x), n): values of the order-th derivatives of all B-splines on the knots."""
    n = len(knots) - degree - 1
    if order:
        low = _spline(knots, degree - 1, x, order - 1)
        out = np.zeros((len(x), n))
        for j in range(n):
            for at, sign in ((j, 1.0), (j + 1, -1.0)):
                gap = knots[at + degree] - knots[at]
                if gap > 0:
                    out[:, j] += sign * degree / gap * low[:, at]
        return out
    b = np.array([(x >= knots[j]) & (x < knots[j + 1]) for j in range(len(knots) - 1)], float).T
    for d in range(1, degree + 1):
        new = np.zeros((len(x), b.shape[1] - 1))
        for j in range(new.shape[1]):
            left, right = knots[j + d] - knots[j], knots[j + d + 1] - knots[j + 1]
            new[:, j] = (0 if left <= 0 else (x - knots[j]) / left * b[:, j]) + (0 if right <= 0 else (knots[j + d + 1] - x) / right * b[:, j + 1])
        b = new
    return b


def spline_blocks(k: int, basis: str, order: int = 1) -> dict[int, np.ndarray]:
    """Derivative of order 1 to 3 of the least-squares spline over the three cells: degree k + 1, smooth but at the cells' ends, where order derivatives are continuous."""
    degree = k + 1
    if not 1 <= order <= min(3, degree):
        raise ValueError("the order is 1 to 3 and at most k + 1")
    inner = np.repeat([0.0, 1.0], degree - order)
    knots = np.concatenate([[-1.0] * (degree + 1), inner, [2.0] * (degree + 1)])
    x, w = B.quadrature(2 * k + 4)
    at = np.concatenate([x - 1, x, x + 1])
    root = np.sqrt(np.tile(w, 3))[:, None]
    fit = np.linalg.lstsq(root * _spline(knots, degree, at), root * _values_of_three(k, basis, at), rcond=None)[0]
    return _blocks_from_values(k, basis, _spline(knots, degree, B.quadrature(k + 1)[0], order) @ fit)


def apply(nodes: DataFrame, mra: MRA, d: int, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """d/dx_d of every tree, weakly. Beyond a world that is not periodic the function is 0."""
    return apply_blocks(nodes, mra, d, weak_blocks(mra.k, mra.basis, a, b), 0 if a == b == 0 else 1)


def apply_blocks(nodes: DataFrame, mra: MRA, d: int, blocks: dict[int, np.ndarray], band: int = 1, order: int = 1) -> DataFrame:
    """The derivative along d that blocks define, of every tree, on its leaf grid widened by the band along d."""
    own = nodes.where("is_end").select(*TREE_KEY)
    steps = list(range(-band, band + 1))
    near = own.select(*TREE_KEY, F.explode(F.array(*map(F.lit, steps))).alias("step"))
    wide = near.where("step <> 0").select(F.col("tree_id"), "n", *[(F.col(c) + F.col("step")).alias(c) if i == d else F.col(c) for i, c in enumerate(AXES)])
    wide = wide.select("tree_id", "n", *wrap_index(mra.world)).where(root_of_node(mra.world) >= 0).distinct()
    ends = write_shared(end_nodes(closure(nodes, wide, mra)) if band else own)
    near = ends.select(*TREE_KEY, F.explode(F.array(*map(F.lit, steps))).alias("step"))
    moved = near.select(F.col("tree_id"), *[F.col(c).alias(f"o{c}") for c in TREE_KEY[1:]], "step", "n", *[(F.col(c) + F.col("step")).alias(c) if i == d else F.col(c) for i, c in enumerate(AXES)])
    moved = moved.select("tree_id", *[f"o{c}" for c in TREE_KEY[1:]], "step", "n", *wrap_index(mra.world))
    found = arith.lookup(nodes, moved.select(*TREE_KEY).distinct(), mra)
    j = moved.join(found, TREE_KEY).select("tree_id", *[F.col(f"o{c}").alias(c) for c in TREE_KEY[1:]], "step", "coef")
    K, sf = mra.k + 1, mra.world.sf[d]

    def run(pdf: pd.DataFrame, c: np.ndarray) -> pd.DataFrame:
        # child scale: the far child of a neighbour is next to this cell's near child, so each step has its child pairs
        s = B.reconstruct(c, mra.dim, mra.k, mra.basis).reshape((len(c),) + (2,) * mra.dim + (K,) * mra.dim)
        at, inner = 1 + mra.dim - 1 - d, 1 + 2 * mra.dim - 1 - d
        s = np.moveaxis(s, (at, inner), (1, -1))
        out = np.zeros_like(s)
        step = pdf.step.to_numpy()
        for o in (0, 1):
            for i in (0, 1):
                for t in (-1, 0, 1):
                    gap = 2 * t + i - o
                    if gap in blocks:
                        rows = step == t
                        out[rows, o] += s[rows, i] @ blocks[gap].T
        out *= ((2.0 ** (pdf.n.to_numpy() + 1) / sf) ** order).reshape((-1,) + (1,) * (s.ndim - 1))
        out = np.moveaxis(out, (1, -1), (at, inner)).reshape(len(c), -1)
        return keys_of(pdf).assign(is_end=True, coef=list(B.compress(out, mra.dim, mra.k, mra.basis)))

    parts = map_coefs(j, NODE, run, mra.blocks * mra.size)
    total = arith.sum_arrays(parts, TREE_KEY, "tree_id string, n int, lx int, ly int, lz int, coef array<double>", mra.blocks * mra.size, ends.count())
    return rebuild(total, mra)


def low_noise(nodes: DataFrame, mra: MRA, d: int, order: int = 1) -> DataFrame:
    return apply_blocks(nodes, mra, d, low_noise_blocks(mra.k, mra.basis, order), 1, order)


def spline(nodes: DataFrame, mra: MRA, d: int, order: int = 1) -> DataFrame:
    return apply_blocks(nodes, mra, d, spline_blocks(mra.k, mra.basis, order), 1, order)


def gradient(nodes: DataFrame, mra: MRA, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """All partial derivatives; tree_id gets /d."""
    out = None
    for d in range(mra.dim):
        part = apply(nodes, mra, d, a, b).withColumn("tree_id", F.concat("tree_id", F.lit(f"/{d}")))
        out = part if out is None else out.unionByName(part)
    return out


def divergence(fields: DataFrame, nodes: DataFrame, mra: MRA, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """Sum over d of c * dT_d / dx_d for fields(out_id, d, tree_id, c)."""
    out = None
    for d in range(mra.dim):
        own = nodes.join(fields.where(F.col("d") == d).select("tree_id").distinct(), "tree_id", "left_semi")
        part = apply(own, mra, d, a, b).withColumn("tree_id", F.concat("tree_id", F.lit(f"/{d}")))
        out = part if out is None else out.unionByName(part)
    terms = fields.select("out_id", F.concat("tree_id", F.lit("/"), F.col("d").cast("string")).alias("tree_id"), "c")
    return arith.add(terms, out, mra)


__all__ = ["apply", "apply_blocks", "divergence", "gradient", "low_noise", "low_noise_blocks", "spline", "spline_blocks", "weak_blocks"]
