"""Convolutions of trees with sums of separable Gaussians, in the non-standard form.

An operator is a table of blocks (oper_id, term, n, dl, block, comp_norm): the 2K x 2K matrix by which one dimension of
a term takes a node's scaling and wavelet coefficients to those of a node of the same scale n that lies dl cells away. Applied
to a tree, every output cell gets, at its own scale, what the input nodes within the band contribute, but for the part
from scaling functions to scaling functions, which counts at the roots alone; what coarse cells get is then handed down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.functions import basis as B
from mwspark.functions import kernels as K
from mwspark.functions.shared import write_shared
from mwspark.functions.trees import NODE, stack
from mwspark.mra import AXES, MRA, TREE_KEY
from mwspark.operators.arith import add
from mwspark.operators.keys import ancestors, wrap_index
from mwspark.operators.project import adaptive
from mwspark.operators.transform import max_norms, rebuild, reconstruct_down

BLOCKS = "oper_id string, term int, power int, n int, dl int, block array<double>, comp_norm array<double>"
MOST_BAND = 96  # cells to either side that a block table reaches, at most
MOST_BYTES = 256 << 20  # of an operator that is broadcast
SIDE = {1: 7, 2: 4, 3: 3}  # log2 of a block's cells a side, by dimensions
SLAB = 4 << 20  # numbers of a block with its halo that are held at once
TASK = 2 << 20  # numbers of output that a task makes
TINY = 1e-15
STRETCH = 128  # distances that a task makes blocks of at once
GRADES, POINTS = 30, 24  # of the quadrature in the distance


def _distances(pieces: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [-1, 1], graded towards -1, 0 and 1, so that Gaussians of any width about these are integrated.

    pieces: parts that each grade is cut into, for kernels that oscillate.
    """
    half = np.concatenate([[0.0], 2.0 ** -np.arange(GRADES, 0, -1), 1 - 2.0 ** -np.arange(2, GRADES + 1), [1.0]])
    half = np.interp(np.arange((len(half) - 1) * pieces + 1) / pieces, np.arange(len(half)), half)
    x, w = B.quadrature(POINTS)
    z = (half[:-1, None] + np.diff(half)[:, None] * x).ravel()
    v = (np.diff(half)[:, None] * w).ravel()
    return np.concatenate([-z, z]), np.concatenate([v, v])


def correlation(k: int, basis: str, z: np.ndarray) -> np.ndarray:
    """(len(z), K, K): the integral of phi_i(u) phi_j(u - z) over the part of the unit interval where both live."""
    x, w = B.quadrature(k + 1)
    low, length = np.maximum(z, 0), 1 - np.abs(z)
    u = low[:, None] + length[:, None] * x
    a = B.scaling_values(k, basis, u.ravel()).reshape(*u.shape, k + 1)
    b = B.scaling_values(k, basis, (u - z[:, None]).ravel()).reshape(*u.shape, k + 1)
    return np.einsum("zp,zpi,zpj->zij", length[:, None] * w, a, b)


def blocks_between(kernel: Callable[[np.ndarray], np.ndarray], n: int, first: int, last: int, k: int, basis: str, sf: float, pieces: int = 1) -> np.ndarray:
    """(last - first + 1, 2K, 2K): blocks of a kernel of the distance at scale n for cells first .. last away."""
    z, w = _distances(pieces)
    side = sf * 2.0 ** -(n + 1)
    m = np.arange(2 * first - 1, 2 * last + 2)
    values = kernel(side * (z[None] - m[:, None])) * w
    r = (side * values @ correlation(k, basis, z).reshape(len(z), -1)).reshape(len(m), k + 1, k + 1)
    at = 2 * np.arange(first, last + 1) - (2 * first - 1)
    quad = np.stack([np.stack([r[at + b - a] for b in (0, 1)], 2) for a in (0, 1)], 1)  # (band, a, i, b, j)
    f = B.filters(k, basis)
    return f @ quad.reshape(len(at), 2 * (k + 1), 2 * (k + 1)) @ f.T


def blocks_of(beta: float, power: int, n: int, band: int, k: int, basis: str, sf: float) -> np.ndarray:
    """(2 band + 1, 2K, 2K): blocks of x^power exp(-beta x^2) at scale n for cells -band .. band away."""
    return blocks_between(lambda x: x**power * np.exp(-np.minimum(beta * x * x, 700.0)), n, -band, band, k, basis, sf)


def component_norms(blocks: np.ndarray, k: int) -> np.ndarray:
    """(rows, 4): norms of the parts (to, from) = scaling-scaling, scaling-wavelet, wavelet-scaling, wavelet-wavelet."""
    parts = blocks.reshape(len(blocks), 2, k + 1, 2, k + 1)
    return np.sqrt((parts**2).sum((2, 4))).reshape(len(blocks), 4)


def build_operator(kernel: DataFrame, mra: MRA, max_scale: int, root_reach: int | None = None) -> DataFrame:
    """The block table of a kernel table, for scales from the roots to max_scale; terms and scales are shared out to tasks.

    coef^(1/dim) goes into each dimension (the first takes the sign). Blocks whose norm is below TINY of the largest are left out.
    root_reach: cells to either side at the root scale of a periodic world.
    """
    root, boxes = mra.world.scale, max(mra.world.boxes)
    k, basis, dim = mra.k, mra.basis, mra.dim
    sf = mra.world.sf[0]
    if len(set(mra.world.sf)) > 1:
        raise ValueError("a convolution needs one scaling factor for all dimensions")
    periodic = any(mra.world.periodic)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                side = sf * 2.0**-r.n
                reach = int(np.ceil(np.sqrt(60 / r.beta) / side)) + 1
                world = boxes * 2 ** (r.n - root)
                most = min(reach, world - 1) if not periodic else min(reach, root_reach * 2 ** (r.n - root) if root_reach is not None else reach)
                band = max(0, min(most, MOST_BAND))
                b = blocks_of(r.beta, r.power, r.n, band, k, basis, sf) * abs(r.coef) ** (1 / dim)
                norm = component_norms(b, k)
                size = np.sqrt((norm**2).sum(1))
                # wavelet parts fall off first; a term without any at this scale is smooth there and adds nothing but at the roots
                wave = np.sqrt((norm[:, 1:] ** 2).sum(1))
                if r.n > root and wave.max() <= TINY * max(1.0, size.max()):
                    continue
                if band < most and r.n > root and max(wave[0], wave[-1]) > 1e-9 * size.max():
                    raise ValueError(f"the band of term {r.term} at scale {r.n} is wider than {MOST_BAND} cells")
                keep = np.flatnonzero(size > TINY * size.max())
                yield pd.DataFrame({"oper_id": r.oper_id, "term": r.term, "power": r.power, "n": r.n, "dl": (keep - band).astype("int32"), "block": list(b[keep].reshape(len(keep), -1)), "comp_norm": list(norm[keep])})

    scales = kernel.withColumn("n", F.explode(F.sequence(F.lit(root), F.lit(max_scale))))
    return scales.repartition("oper_id", "term", "n").mapInPandas(run, BLOCKS)


def band_widths(oper: DataFrame, mra: MRA, prec: float) -> DataFrame:
    """(oper_id, depth, component, width): by depth below the roots and part, the farthest cell with a norm above max(1e-15, prec / (8 2^depth))."""
    parts = oper.select("oper_id", (F.col("n") - mra.world.scale).alias("depth"), "dl", F.posexplode("comp_norm").alias("component", "norm"))
    least = F.greatest(F.lit(TINY), F.lit(prec) / (8 * F.pow(F.lit(2.0), F.col("depth"))))
    return parts.where(F.col("norm") > least).groupBy("oper_id", "depth", "component").agg(F.max(F.abs("dl")).alias("width"))


def build_time_evolution(spark: SparkSession, mra: MRA, t: float, finest_scale: int) -> DataFrame:
    """The block table of exp(i t d^2/dx^2), the free particle's motion over a time t; oper_id "re" and "im".

    Its kernel exp(i x^2 / 4t) / sqrt(4 pi i t) is smooth where it is near and oscillates where it is far, so the blocks reach over
    the whole world, and those near the diagonal are the small ones. Scales and stretches of distances are shared out to tasks.
    """
    root, k, basis = mra.world.scale, mra.k, mra.basis
    if mra.dim != 1 or t <= 0:
        raise ValueError("the free time evolution is one-dimensional and goes forward in time")
    sf, boxes, periodic = mra.world.sf[0], mra.world.boxes[0], mra.world.periodic[0]
    if periodic:
        raise ValueError("the free time evolution needs a world with ends")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                # phase over the largest grade, a quarter of a child's side, at the farthest distance
                far = sf * 2.0**-r.n * (max(abs(r.first), abs(r.last)) + 1)
                pieces = 1 + int(far / (2 * t) * sf * 2.0 ** -(r.n + 3) / 4)
                b = blocks_between(lambda x: np.exp(1j * x * x / (4 * t)) / np.sqrt(4j * np.pi * t), r.n, r.first, r.last, k, basis, sf, pieces)
                for name, part in (("re", b.real), ("im", b.imag)):
                    norm = component_norms(part, k)
                    keep = np.flatnonzero((norm[:, 0 if r.n == root else 1 :] > TINY).any(1))
                    if len(keep):
                        yield pd.DataFrame({"oper_id": name, "term": np.int32(0), "power": np.int32(0), "n": np.int32(r.n), "dl": (keep + r.first).astype("int32"), "block": list(part[keep].reshape(len(keep), -1)), "comp_norm": list(norm[keep])})

    scales = spark.range(root, finest_scale + 1).select(F.col("id").cast("int").alias("n"))
    most = (F.lit(boxes) * F.pow(F.lit(2.0), F.col("n") - root)).cast("int") - 1
    parts = scales.withColumn("first", F.explode(F.sequence(-most, most, F.lit(STRETCH)))).withColumn("last", F.least(F.col("first") + STRETCH - 1, most))
    return parts.repartition("n", "first").mapInPandas(run, BLOCKS)


def corner_widths(oper: DataFrame, mra: MRA, prec: float) -> DataFrame:
    """(oper_id, depth, component, width): by depth below the roots and part, how far cells must be for a norm above prec / 10.

    The opposite of a band: blocks nearer than the width can be left out. The part from scaling to scaling functions counts at the roots
    alone, elsewhere it is left out whole; parts that are small everywhere have no row.
    """
    parts = oper.select("oper_id", (F.col("n") - mra.world.scale).alias("depth"), "dl", F.posexplode("comp_norm").alias("component", "norm"))
    seen = parts.where((F.col("norm") > prec / 10) & ((F.col("component") > 0) | (F.col("depth") == 0)))
    return seen.groupBy("oper_id", "depth", "component").agg(F.min(F.abs("dl")).alias("width"))


@dataclass
class Operator:
    """A block table on the driver, to be broadcast: by scale the terms' blocks and norms; powers[d] names the power used in dimension d."""

    blocks: dict[int, dict[int, dict[int, dict[int, np.ndarray]]]]  # n, term, power, dl
    norms: dict[int, dict[int, dict[int, dict[int, tuple[float, float]]]]]
    sign: dict[int, float]
    powers: tuple[int, ...]

    def gaps(self, n: int, root: int, least: float) -> dict[int, list[list[int]]]:
        """By term and dimension the distances in cells from which a node of norm 1 may give more than least; terms without any are left out."""
        out = {}
        for term, by_power in self.norms.get(n, {}).items():
            top = [(max((s for s, _ in by_power[p].values()), default=0.0), max((w for _, w in by_power[p].values()), default=0.0)) for p in self.powers]
            kept = []
            for d, p in enumerate(self.powers):
                others = [t for e, t in enumerate(top) if e != d]
                full = float(np.prod([s for s, _ in others]))
                wavy = sum(w * float(np.prod([s for f, (s, _) in enumerate(others) if f != e])) for e, (_, w) in enumerate(others))
                kept.append([dl for dl, (s, w) in by_power[p].items() if (n == root and s * full > least) or w * full + s * wavy > least])
            if all(kept):
                out[term] = kept
        return out

    def reach(self, n: int, root: int, least: float) -> int:
        """The farthest cell, in any dimension, from which anything above least may come at scale n."""
        return max((abs(dl) for kept in self.gaps(n, root, least).values() for some in kept for dl in some), default=0)


def collect_operator(oper: DataFrame, sign: dict[int, float], mra: MRA, powers: tuple[int, ...]) -> Operator:
    """A block table of one operator: terms x scales x band blocks, whose size is checked before it is collected."""
    held = oper.agg(F.sum(F.size("block")) * 8).first()[0] or 0
    if held > MOST_BYTES:
        raise ValueError(f"an operator of {held} bytes is more than {MOST_BYTES}")
    blocks: dict = {}
    norms: dict = {}
    two = 2 * (mra.k + 1)
    for r in oper.collect():
        blocks.setdefault(r.n, {}).setdefault(r.term, {}).setdefault(r.power, {})[r.dl] = np.array(r.block).reshape(two, two)
        full, wave = float(np.sqrt(np.square(r.comp_norm).sum())), float(np.sqrt(np.square(r.comp_norm[1:]).sum()))
        norms.setdefault(r.n, {}).setdefault(r.term, {}).setdefault(r.power, {})[r.dl] = (full, wave)
    return Operator(blocks, norms, sign, powers)


def _axes(dim: int) -> list[int]:
    """The axes of rows of nodes (2, .., 2, K, .., K), so that a dimension's block axis stands before its inner axis."""
    return [0, *[x for d in range(dim) for x in (1 + d, 1 + dim + d)]]


def to_boxes(a: np.ndarray, dim: int, k1: int) -> np.ndarray:
    """Rows of coefficients as (rows, 2K, .., 2K); the last axis is x."""
    return a.reshape((len(a),) + (2,) * dim + (k1,) * dim).transpose(_axes(dim)).reshape((len(a),) + (2 * k1,) * dim)


def from_boxes(a: np.ndarray, dim: int, k1: int) -> np.ndarray:
    return a.reshape((len(a),) + (2, k1) * dim).transpose(np.argsort(_axes(dim))).reshape(len(a), -1)


class Cells:
    """The nodes that one block of output cells needs, by scale: those of the block's scale n, and leaves above them."""

    def __init__(self, n: int, scale: np.ndarray, at: np.ndarray, coef: np.ndarray, mra: MRA) -> None:
        self.mra, self.by_scale = mra, {}
        for m in np.unique(scale):
            rows = np.flatnonzero(scale == m)
            low = at[rows].min(0)
            extent = at[rows].max(0) - low + 1
            order = np.argsort(self._number(at[rows], low, extent))
            self.by_scale[int(m)] = low, extent, self._number(at[rows], low, extent)[order], coef[rows[order]]
        self.n, self.top = n, min(self.by_scale, default=n)

    @staticmethod
    def _number(at: np.ndarray, low: np.ndarray, extent: np.ndarray) -> np.ndarray:
        x = at - low
        return (x[:, 0] * extent[1] + x[:, 1]) * extent[2] + x[:, 2]

    def get(self, at: np.ndarray, m: int) -> np.ndarray:
        """Coefficients of cells (rows, 3) of scale m: of nodes, generated below leaves, or zero where there is neither."""
        mra = self.mra
        out = np.zeros((len(at), mra.blocks * mra.size))
        left = np.arange(len(at))
        if m in self.by_scale:
            low, extent, numbers, coef = self.by_scale[m]
            fits = np.flatnonzero(((at >= low) & (at < low + extent)).all(1))
            wanted = self._number(at[fits], low, extent)
            place = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
            hit = numbers[place] == wanted
            out[fits[hit]] = coef[place[hit]]
            left = np.setdiff1d(left, fits[hit], assume_unique=True)
        if m > self.top and len(left):
            up = at[left].copy()
            up[:, : mra.dim] >>= 1
            parents, which = np.unique(up, axis=0, return_inverse=True)
            s = B.reconstruct(self.get(parents, m - 1), mra.dim, mra.k, mra.basis).reshape(len(parents), mra.blocks, mra.size)
            child = ((at[left, : mra.dim] & 1) << np.arange(mra.dim)).sum(1)
            out[left, : mra.size] = s[which.ravel(), child]
        return out


def _along(matrix: np.ndarray, x: np.ndarray, axis: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(matrix, x, axes=(1, axis)), 0, axis)


def convolve_block(outputs: np.ndarray, n: int, cells: Cells, oper: Operator, mra: MRA, least: float, keep=None) -> np.ndarray:
    """Coefficients (rows, 2^D K^D) of output cells (rows, 3) of scale n that lie near each other.

    The cells' box with its halo is one array in which a term is a product of banded matrices, one for each dimension, so
    a term costs dimensions times band, not band to the power of dimensions. The box is taken in slabs of the last dimension.
    keep says which input cells count. What a term gives below least is left out.
    """
    dim, k1, root = mra.dim, mra.k + 1, mra.world.scale
    m, width = 2 * k1, mra.blocks * mra.size
    low, high = outputs.min(0), outputs.max(0) + 1
    sides = (high - low)[:dim]
    norm = max((float(np.sqrt((c * c).sum(1).max(initial=0))) for _, _, _, c in cells.by_scale.values()), default=0.0)
    gaps = oper.gaps(n, root, least / norm) if norm > 0 else {}
    total = np.zeros(tuple(int(s) * m for s in sides[::-1]))
    reach = [max((abs(g) for kept in gaps.values() for g in kept[d]), default=0) for d in range(dim)]
    if not gaps:
        return np.zeros((len(outputs), width))
    ranges = [np.arange(low[d] - reach[d], high[d] + reach[d]) for d in range(dim)]
    layer = int(np.prod([len(r) for r in ranges[:-1]], initial=1)) * width
    step = max(1, SLAB // layer)

    def matrix(term: int, d: int, part: int) -> np.ndarray:
        """(outputs, inputs) of a term along dimension d; part: components of a cell, all or the scaling ones."""
        blocks = oper.blocks[n][term][oper.powers[d]]
        out = np.zeros((int(sides[d]), part, len(ranges[d]), part))
        i = np.arange(int(sides[d]))
        for g in gaps[term][d]:
            out[i, :, i + reach[d] + g, :] = blocks[g][:part, :part]
        return out.reshape(int(sides[d]) * part, -1)

    parts = (m,) if n == root else (m, k1)
    matrices = {(t, d, part): matrix(t, d, part) for t in gaps for d in range(dim) for part in parts}
    for z in range(0, len(ranges[-1]), step):
        last = ranges[-1][z : z + step]
        axes = [*ranges[:-1], last]
        at = np.zeros((int(np.prod([len(r) for r in axes])), 3), np.int64)
        for d, g in enumerate(np.meshgrid(*axes[::-1], indexing="ij")[::-1]):
            at[:, d] = g.ravel()
        inside = np.ones(len(at), bool) if keep is None else keep(at)
        rows = np.zeros((len(at), width))
        rows[inside] = cells.get(at[inside], n)
        if not rows.any():
            continue
        shape = [len(r) for r in axes[::-1]]
        # (cells, components) of a dimension side by side, z first
        box = to_boxes(rows, dim, k1).reshape(*shape, *(m,) * dim).transpose([x for d in range(dim) for x in (d, dim + d)])
        for part, sign in zip(parts, (1.0, -1.0), strict=False):
            some = box[tuple(x for _ in range(dim) for x in (slice(None), slice(part)))].reshape([s * part for s in shape])
            got = np.zeros([int(s) * part for s in sides[::-1]])
            for t in gaps:
                x = some
                for d in range(dim - 1):
                    x = _along(matrices[t, d, part], x, dim - 1 - d)
                got += oper.sign[t] * _along(matrices[t, dim - 1, part][:, z * part : (z + len(last)) * part], x, 0)
            view = total.reshape([x for s in sides[::-1] for x in (int(s), m)])
            view[tuple(x for _ in range(dim) for x in (slice(None), slice(part)))] += sign * got.reshape([x for s in sides[::-1] for x in (int(s), part)])
    order = [2 * d for d in range(dim)] + [2 * d + 1 for d in range(dim)]
    nodes = total.reshape([x for s in sides[::-1] for x in (int(s), m)]).transpose(order)
    place = tuple(outputs[:, d] - low[d] for d in range(dim))[::-1]
    return from_boxes(nodes[place], dim, k1)


def local_precision(prec_trees: DataFrame, mra: MRA):
    """A function that adds tight to cells: 1 / the largest norm density of the prec trees (under the cells' tree_id) there."""
    norms = max_norms(prec_trees, mra).groupBy(*TREE_KEY).agg(F.max("max_sq").alias("q"))
    norms = write_shared(norms)

    def with_tight(cells: DataFrame) -> DataFrame:
        up = ancestors(cells.select(*TREE_KEY), mra.world.scale)
        seen = norms.select(F.col("tree_id"), F.col("n").alias("an"), *[F.col(a).alias("a" + a[1]) for a in AXES], "q")
        deepest = up.join(seen, ["tree_id", "an", "ax", "ay", "az"]).groupBy(*TREE_KEY).agg(F.max_by("q", "an").alias("q"))
        return cells.join(deepest, TREE_KEY, "left").withColumn("tight", F.coalesce(1 / F.greatest(F.sqrt("q"), F.lit(1e-8)), F.lit(1.0))).drop("q")

    return with_tight


def apply(oper: Operator, nodes: DataFrame, mra: MRA, prec: float, max_iter: int = -1, abs_prec: bool = False, start: DataFrame | None = None, field: str | None = None, prec_trees: DataFrame | None = None) -> DataFrame:
    """The convolution of every tree of nodes (tree_id stays), from the roots or start, refined while wavelets are above prec.

    What counts is judged for each tree by its own norm. field: "near" takes only input cells inside the world's unit cell, "far" only
    those outside (periodic worlds). prec_trees: tighter where these trees (same tree_id) are large.

    Output cells lie in blocks, cubes of at most SIDE cells a side. A block gets the nodes of its own scale in the blocks within the
    band, once each, and the leaves that cover such blocks or lie in them; cells below leaves are made where they are used. So a
    task's input is bounded by the nodes that exist, not by the cells of the halo, and its arrays by a slab of the block with its halo.
    """
    spark, dim, root = nodes.sparkSession, mra.dim, mra.world.scale
    width = mra.blocks * mra.size
    shared = spark.sparkContext.broadcast(oper)
    nodes = nodes.select(*TREE_KEY, "is_end", "coef", "sq_norm")
    norm = write_shared(nodes.where("is_end").groupBy("tree_id").agg(F.sqrt(F.sum("sq_norm")).alias("norm")))
    share = max(TINY, (prec if prec > 0 else 1e-9) * 1e-2 / max(1, len(oper.sign)) ** 0.5)  # of the norm, or as it is
    largest = float(norm.agg(F.max("norm")).first()[0] or 0.0)
    if start is None:
        start = nodes.where(F.col("n") == root).select(*TREE_KEY).distinct()
    reach = {n: oper.reach(n, root, share / (max(1.0, largest) if abs_prec else 1.0)) for n in sorted(oper.blocks)}
    # side 2^shift of a block, not above a root cell, and how many blocks away input may come from
    shift = {n: min(SIDE[dim], n - root) for n in reach}
    blocks_off = {n: -(-reach[n] >> shift[n]) if reach[n] else 0 for n in reach}
    of_scale = lambda table, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), F.lit(0)) if table else F.lit(0)
    world = mra.world

    def calc(cells: DataFrame) -> DataFrame:
        keys = ["tree_id", "n", "bx", "by", "bz"]
        cells = cells.select(*TREE_KEY).withColumn("shift", of_scale(shift, F.col("n")))
        cells = cells.select(*TREE_KEY, "shift", *[F.expr(f"shiftright({a}, {'shift' if d < dim else '0'})").alias("b" + a[1]) for d, a in enumerate(AXES)])
        cells = write_shared(cells.join(norm, "tree_id", "left"))
        # the blocks within the band: u is where they lie, w (in a periodic world) what is there
        around = cells.select(*keys, "shift").distinct().withColumn("off", of_scale(blocks_off, F.col("n"))).withColumn("bn", F.col("n") - F.col("shift"))
        for d, a in enumerate(AXES):
            b = F.col("b" + a[1])
            low = F.lit(float(world.corner[d] if d < dim else 0)) * F.pow(F.lit(2.0), F.col("bn") - root)
            high = F.lit(float(world.corner[d] + world.boxes[d] if d < dim else 1)) * F.pow(F.lit(2.0), F.col("bn") - root) - 1
            free = d < dim and world.periodic[d]
            first, last = (b - F.col("off"), b + F.col("off")) if free else (F.greatest(b - F.col("off"), low.cast("int")), F.least(b + F.col("off"), high.cast("int")))
            around = around.withColumn("u" + a[1], F.explode(F.sequence(first, last)) if d < dim else F.lit(0))
        wrapped = around.select(*keys, "bn", "ux", "uy", "uz", *[F.col("u" + a[1]).alias(a) for a in AXES]).select(*keys, "bn", "ux", "uy", "uz", *wrap_index(world, F.col("bn")))
        around = write_shared(wrapped.withColumnsRenamed({"lx": "wx", "ly": "wy", "lz": "wz"}))
        asked = [r[0] for r in cells.select("n").distinct().collect()]
        # nodes of scale n, and leaves of coarser scales that lie in a block, by the block of scale n - shift ..
        some = nodes.select(*TREE_KEY, "is_end", "coef").withColumn("to", F.explode(F.array(*[F.lit(n) for n in asked])))
        within = some.where((F.col("n") <= F.col("to")) & (F.col("n") >= F.col("to") - of_scale(shift, F.col("to"))) & ((F.col("n") == F.col("to")) | F.col("is_end")))
        up = F.col("n") - F.col("to") + of_scale(shift, F.col("to"))
        within = within.withColumn("up", up).select("tree_id", F.col("to").alias("n"), F.col("n").alias("m"), *AXES, "coef", *[F.expr(f"shiftright({a}, {'up' if d < dim else '0'})").alias("w" + a[1]) for d, a in enumerate(AXES)])
        # .. and leaves that cover whole blocks of the band; in a periodic world all count where their images lie
        images = [(F.col(a) + ((F.col("u" + a[1]) - F.col("w" + a[1])) * F.pow(F.lit(2.0), F.col("m") - F.col("bn"))).cast("int")).alias("i" + a[1]) for a in AXES]
        given = around.join(within, ["tree_id", "n", "wx", "wy", "wz"]).select(*keys, "m", *images, "coef")
        covered = around.select("tree_id", F.col("bn").alias("n"), *[F.col("w" + a[1]).alias(a) for a in AXES]).distinct()
        leaves = nodes.where("is_end").select("tree_id", F.col("n").alias("an"), *[F.col(a).alias("a" + a[1]) for a in AXES], "coef")
        above = ancestors(covered, root, itself=False).join(leaves.drop("coef"), ["tree_id", "an", "ax", "ay", "az"])
        above = above.select("tree_id", F.col("n").alias("bn"), *[F.col(a).alias("w" + a[1]) for a in AXES], F.col("an").alias("m"), *[F.col("a" + a[1]).alias(a) for a in AXES])
        above = around.join(above, ["tree_id", "bn", "wx", "wy", "wz"]).select(*keys, "m", *images, *AXES).distinct()
        above = above.join(leaves.select("tree_id", F.col("an").alias("m"), *[F.col("a" + a[1]).alias(a) for a in AXES], "coef"), ["tree_id", "m", *AXES])
        given = given.unionByName(above.select(*keys, "m", "ix", "iy", "iz", "coef"))
        tasks = 1 + cells.count() * width // TASK
        task = F.pmod(F.xxhash64(*keys), F.lit(tasks)).alias("task")
        cells = cells.select(*[F.col(c).alias(c) for c in [*keys, *AXES, "norm"]], task)
        given = given.select("*", task)

        def one(cell: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros((len(cell), width))
            cell, node = cell.reset_index(drop=True), node.reset_index(drop=True)
            held = node.groupby(keys, sort=False).indices
            for key, rows in cell.groupby(keys, sort=False).indices.items():
                near = held.get(key)
                if near is not None:
                    n = int(key[1])
                    source = Cells(n, node.m.to_numpy()[near], node[["ix", "iy", "iz"]].to_numpy(np.int64)[near], stack(node.coef.iloc[near], width), mra)
                    least = share * (1.0 if abs_prec else float(cell.norm.iloc[rows[0]] or 0.0))
                    corner = np.array([world.corner[d] if d < dim else 0 for d in range(3)]) * 2.0 ** (n - root)
                    beyond = np.array([world.corner[d] + world.boxes[d] if d < dim else 1 for d in range(3)]) * 2.0 ** (n - root)
                    inside = lambda at: ((at[:, :dim] >= corner[:dim]) & (at[:, :dim] < beyond[:dim])).all(1)  # noqa: E731, B023
                    keep = None if field is None else inside if field == "near" else lambda at: ~inside(at)  # noqa: B023
                    out[rows] = convolve_block(cell[list(AXES)].to_numpy(np.int64)[rows], n, source, shared.value, mra, least, keep)
            return cell[["tree_id", "n", *AXES]].assign(is_end=True, coef=list(out))

        return cells.groupBy("task").cogroup(given.groupBy("task")).applyInPandas(one, NODE)

    def finish(done: DataFrame) -> DataFrame:
        whole = reconstruct_down(done, mra, add=True)
        return rebuild(whole.where("is_end").select(*TREE_KEY, "coef"), mra)

    return adaptive(start, calc, mra, prec, max_iter, abs_prec, finish=finish, local=local_precision(prec_trees, mra) if prec_trees is not None else None)


def apply_components(oper: Operator, functions: DataFrame, nodes: DataFrame, metric: dict[tuple[int, int], float], mra: MRA, prec: float, **options) -> tuple[DataFrame, DataFrame]:
    """Convolution of functions of several components: component o of the result is the sum over i of metric[i, o] times that of component i.

    functions(fn_id, comp, tree_id); the result's rows and nodes, tree_id fn_id/comp. Several i for one o are summed.
    """
    spark = nodes.sparkSession
    used = nodes.join(functions.select("tree_id").distinct(), "tree_id", "left_semi")
    done = write_shared(apply(oper, used, mra, prec, **options))
    table = F.broadcast(spark.createDataFrame([(i, o, float(c)) for (i, o), c in metric.items()], "comp int, o int, c double"))
    terms = functions.join(table, "comp").select(F.concat_ws("/", "fn_id", F.col("o").cast("string")).alias("out_id"), "tree_id", "c", "fn_id", "o")
    out = add(terms.select("out_id", "tree_id", "c"), done, mra)
    return terms.select("fn_id", F.col("o").alias("comp"), F.col("out_id").alias("tree_id")).distinct(), out


def apply_complex(real: Operator, imag: Operator, nodes: DataFrame, mra: MRA, prec: float, **options) -> DataFrame:
    """(A + iB)(f + ig) for functions kept as trees <id>/re and <id>/im: Af - Bg and Ag + Bf under the same names."""
    a = apply(real, nodes, mra, prec, **options).withColumn("tree_id", F.concat("tree_id", F.lit("/A")))
    b = apply(imag, nodes, mra, prec, **options).withColumn("tree_id", F.concat("tree_id", F.lit("/B")))
    both = write_shared(a.unionByName(b))
    ids = nodes.select(F.regexp_extract("tree_id", "^(.*)/(re|im)$", 1).alias("id")).distinct()

    def term(out: str, part: str, op: str, c: float) -> DataFrame:
        return ids.select(F.concat("id", F.lit(f"/{out}")).alias("out_id"), F.concat("id", F.lit(f"/{part}/{op}")).alias("tree_id"), F.lit(c).alias("c"))

    terms = reduce(DataFrame.unionByName, [term("re", "re", "A", 1.0), term("re", "im", "B", -1.0), term("im", "im", "A", 1.0), term("im", "re", "B", 1.0)])
    return add(terms, both, mra)


def _make(spark: SparkSession, kernel: pd.DataFrame, mra: MRA, max_scale: int, reach: int | None = None, powers: tuple[int, ...] | None = None) -> Operator:
    table = K.table(spark, kernel)
    sign = {int(t): float(np.sign(c)) for t, c in zip(kernel.term, kernel.coef, strict=True)}
    return collect_operator(write_shared(build_operator(table, mra, max_scale, reach)), sign, mra, powers or (int(kernel.power.iloc[0]),) * mra.dim)


def _distances_of(mra: MRA, prec: float, reach: int | None) -> tuple[float, float, float]:
    """Precision of the expansion, smallest and largest distance."""
    eps = prec / 10 if reach is None else prec / 100
    return eps, mra.world.min_distance(eps, mra.max_scale), mra.world.max_distance() * (1 if reach is None else 2 * reach + 1)


def identity_operator(spark: SparkSession, mra: MRA, prec: float, max_scale: int) -> Operator:
    return _make(spark, K.rows("identity", K.identity(prec / 10, mra.dim)), mra, max_scale)


def heat_operator(spark: SparkSession, mra: MRA, t: float, max_scale: int, reach: int | None = None) -> Operator:
    return _make(spark, K.rows("heat", K.heat(t, mra.dim)), mra, max_scale, reach)


def derivative_operator(spark: SparkSession, mra: MRA, prec: float, max_scale: int) -> Operator:
    """Convolution with a differentiated narrow Gaussian, in one dimension."""
    if mra.dim != 1:
        raise ValueError("the derivative convolution is one-dimensional")
    return _make(spark, K.rows("derivative", K.derivative(prec / 10), 1), mra, max_scale)


def poisson_operator(spark: SparkSession, mra: MRA, prec: float, max_scale: int, reach: int | None = None) -> Operator:
    return _make(spark, K.rows("poisson", K.poisson(*_distances_of(mra, prec, reach))), mra, max_scale, reach)


def helmholtz_operator(spark: SparkSession, mra: MRA, mu: float, prec: float, max_scale: int, reach: int | None = None) -> Operator:
    return _make(spark, K.rows("helmholtz", K.helmholtz(mu, *_distances_of(mra, prec, reach))), mra, max_scale, reach)


def cartesian_operator(spark: SparkSession, kernel: tuple[np.ndarray, np.ndarray], powers: tuple[int, ...], mra: MRA, max_scale: int) -> Operator:
    """A kernel times x^p y^q z^r: every term is built with each power, and each dimension takes its own."""
    parts = [K.rows("cartesian", kernel, p) for p in sorted(set(powers))]
    return _make(spark, pd.concat(parts, ignore_index=True), mra, max_scale, powers=powers)


def time_evolution_operators(spark: SparkSession, mra: MRA, t: float, finest_scale: int) -> tuple[Operator, Operator]:
    """Real and imaginary part of exp(i t d^2/dx^2), for apply_complex."""
    both = write_shared(build_time_evolution(spark, mra, t, finest_scale))
    return tuple(collect_operator(both.where(F.col("oper_id") == part), {0: 1.0}, mra, (0,)) for part in ("re", "im"))
