"""Multiresolution transforms of whole trees.

compress_up and reconstruct_down work by bands of scales. The nodes of a band under one ancestor at the band's top are at most
SUBTREE leaves' worth; a task takes some such subtrees, of any trees, by a hash and does all levels of the band.
Between bands only the scaling blocks at the top of each subtree go on, and each band is written, so plans don't grow with
the depth and no task holds more than its share, whatever the shape of the trees.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mwspark.functions import basis as B
from mwspark.functions.trees import NODE, keys_of, map_coefs, no_nodes, stack, with_norms, write_shared
from mwspark.mra import AXES, KEY, MRA, TREE_KEY
from mwspark.operators.keys import ancestors

SUBTREE = 4096  # leaves of a subtree at most
NODES_PER_TASK = 8192
SCALING = "tree_id string, n int, lx int, ly int, lz int, s array<double>"


def _lift(tree: np.ndarray, cell: np.ndarray, s: np.ndarray, mra: MRA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees (as numbers), translations and 2^(D/2) times the coefficients of the nodes one level above the given scaling blocks; a missing child counts as zero."""
    up, at = cell >> 1, tree
    for d in range(mra.dim):
        low = up[:, d].min()
        _, at = np.unique(at * (up[:, d].max() - low + 1) + up[:, d] - low, return_inverse=True)
    _, first = np.unique(at, return_index=True)
    a = np.zeros((len(first), mra.blocks, mra.size))
    np.add.at(a, (at, ((cell & 1) << np.arange(mra.dim)).sum(1)), s)
    return tree[first], up[first], B.compress(a.reshape(len(a), -1), mra.dim, mra.k, mra.basis, whole=True)


def _climb(pdf: pd.DataFrame, mra: MRA, stop: int) -> pd.DataFrame:
    """All nodes from the given scaling blocks (of any scales) up to scale stop.

    What climbs is in units of its scale's power of sqrt(2), so that a coefficient is rounded by such powers once, not at every level.
    """
    out, s, n = [], stack(pdf["s"], mra.size), pdf.n.to_numpy()
    tree, names = pd.factorize(pdf.tree_id)
    cell = pdf[list(AXES[: mra.dim])].to_numpy(np.int64)
    front = tree[:0], cell[:0], s[:0]
    unit = 2.0 ** (0.5 * mra.dim * (n.max() - np.arange(n.max() + 1 - stop) - stop))  # by scale - stop
    s = s * unit[n - stop, None]
    for scale in range(int(n.max()), stop, -1):
        here = n == scale
        front = tuple(np.concatenate([above, own[here]]) for above, own in zip(front, (tree, cell, s), strict=True))
        if len(front[0]):
            t, c, coef = _lift(*front, mra)
            out.append((t, np.full(len(t), scale - 1), c, coef / unit[scale - 1 - stop]))
            front = t, c, coef[:, : mra.size]
    if not out:
        return pdf[TREE_KEY].iloc[:0].assign(is_end=False, coef=[])
    t, n, c, coef = (np.concatenate(x) for x in zip(*out, strict=True))
    axes = {name: c[:, d] if d < mra.dim else 0 for d, name in enumerate(AXES)}
    return pd.DataFrame({"tree_id": names.to_numpy()[t], "n": n, **axes, "is_end": False, "coef": list(coef)})


def band_height(dim: int) -> int:
    """Levels of a band: a subtree of so many has SUBTREE leaves at most."""
    return max(1, (SUBTREE.bit_length() - 1) // dim)


def _subtree(scale: int, tasks: int):
    """Column: the task of a node's subtree, by its ancestor at the given scale."""
    return F.pmod(F.xxhash64("tree_id", *[F.expr(f"shiftright({a}, n - ({scale}))") for a in AXES]), F.lit(tasks)).alias("task")


def _climb_to(mra: MRA, stop: int):
    return lambda pdf: _climb(pdf, mra, stop)


def compress_up(scaling: DataFrame, mra: MRA, written: bool = False) -> DataFrame:
    """All nodes above the given scaling blocks (tree_id, n, l.., s), is_end false, without norms. written: the blocks are read from a table."""
    stop, height = mra.world.scale, band_height(mra.dim)
    scaling = scaling if written else write_shared(scaling)
    count = {r[0]: r[1] for r in scaling.groupBy("n").count().collect()}
    front = scaling.where(F.col("n") == max(count, default=stop)).select(*TREE_KEY, "s")
    out = None
    bottom = max(count, default=stop)
    tops = 0
    while bottom > stop:
        anchor = max(stop, bottom - height)
        inside = scaling.where((F.col("n") > anchor) & (F.col("n") < bottom)).select(*TREE_KEY, "s")
        rows = sum(c for n, c in count.items() if anchor < n <= bottom) + tops
        band = front.unionByName(inside)
        task = _subtree(anchor, 1 + rows // NODES_PER_TASK)
        band = write_shared(band.groupBy(task).applyInPandas(_climb_to(mra, anchor), NODE))
        out = band if out is None else out.unionByName(band)
        top = band.where(F.col("n") == anchor).select(*TREE_KEY, F.slice("coef", 1, mra.size).alias("s"))
        tops = top.count() if anchor > stop else 0
        front, bottom = scaling.where(F.col("n") == anchor).select(*TREE_KEY, "s").unionByName(top), anchor
    return no_nodes(scaling.sparkSession) if out is None else out


def rebuild(leaves: DataFrame, mra: MRA, written: bool = False) -> DataFrame:
    """A whole tree with norms from its leaves' coefficients: inner nodes come from their children. written: leaves are a table already."""
    s = leaves.select(*TREE_KEY, F.slice("coef", 1, mra.size).alias("s"))
    inner = compress_up(s, mra, written)
    return with_norms(leaves.select(*TREE_KEY, F.lit(True).alias("is_end"), "coef").union(inner), mra)


def child_scaling(nodes: DataFrame, mra: MRA) -> DataFrame:
    """Scaling blocks (tree_id, n, l.., s) of all children of the nodes."""
    steps = B.child_steps(mra.dim)

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        s = B.reconstruct(a, mra.dim, mra.k, mra.basis).reshape(-1, mra.size)
        keys = keys_of(pdf).loc[np.repeat(np.arange(len(pdf)), mra.blocks)].reset_index(drop=True)
        keys["n"] += 1
        for d in range(mra.dim):
            keys[AXES[d]] = 2 * keys[AXES[d]] + np.tile(steps[:, d], len(pdf))
        return keys.assign(s=list(s))

    return map_coefs(nodes, SCALING, run, mra.blocks * mra.size)


def map_at_cells(nodes: DataFrame, target: DataFrame, mra: MRA, schema: str, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> DataFrame:
    """fn(rows of target, coefficient matrix), as map_coefs: each tree's coefficients at target's cells (tree_id, n, l.., and more columns).

    A cell that is a node of its tree has that node's coefficients. Below a leaf there are no wavelets: the leaf is reconstructed along
    the path to the cell. One equi-join finds either, over the cell's ancestors at scales where there are leaves at all.
    Cells that no leaf covers find nothing.
    """
    held = {n: ends for n, ends in nodes.groupBy("n").agg(F.max("is_end")).collect()}
    itself = F.col("an") == F.col("n")
    wanted = itself & F.col("an").isin(list(held)) | ~itself & F.col("an").isin([n for n, ends in held.items() if ends])
    up = ancestors(target, mra.world.scale).where(wanted)
    ends = nodes.select("tree_id", F.col("n").alias("en"), *[F.col(a).alias("e" + a[1]) for a in AXES], "is_end", "coef")
    on = [F.col("t.tree_id") == F.col("e.tree_id"), F.col("t.an") == F.col("e.en")] + [F.col(f"t.a{a[1]}") == F.col(f"e.e{a[1]}") for a in AXES]
    on.append((F.col("t.n") == F.col("e.en")) | F.col("e.is_end"))
    j = up.alias("t").join(ends.alias("e"), reduce(lambda a, b: a & b, on)).select(*[F.col(f"t.{c}") for c in target.columns], "en", "coef")

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        n, en = pdf.n.to_numpy(), pdf.en.to_numpy()
        for step in range(int((n - en).max(initial=0))):
            at = np.flatnonzero(n - en > step)
            s = B.reconstruct(a[at], mra.dim, mra.k, mra.basis).reshape(len(at), mra.blocks, mra.size)
            child = np.zeros(len(at), np.int64)
            for d in range(mra.dim):
                child |= ((pdf[AXES[d]].to_numpy(np.int64)[at] >> (n[at] - en[at] - step - 1)) & 1) << d
            a[at] = 0
            a[at, : mra.size] = s[np.arange(len(at)), child]
        return fn(pdf, a)

    return map_coefs(j, schema, run, mra.blocks * mra.size)


def push_down(leaves: DataFrame, target: DataFrame, mra: MRA) -> DataFrame:
    """Coefficients of each tree at target cells (tree_id, n, l..) at or below its leaves."""
    ends = leaves.select(*TREE_KEY, F.lit(True).alias("is_end"), "coef")
    return map_at_cells(ends, target.select(*TREE_KEY), mra, NODE, lambda pdf, a: keys_of(pdf).assign(is_end=True, coef=list(a)))


def _descend(pdf: pd.DataFrame, mra: MRA, bottom: int, add: bool) -> pd.DataFrame:
    """The nodes of some subtrees with the scaling blocks that come from above, and what they give to children at scale bottom (given)."""
    width = mra.blocks * mra.size
    given = pdf[pdf.given.to_numpy(bool)].reset_index(drop=True)
    own = pdf[~pdf.given.to_numpy(bool)]
    out = []
    steps = B.child_steps(mra.dim)
    for n in range(int(pdf.n.min()), bottom):
        level = own[own.n == n].reset_index(drop=True)
        if not len(level):
            given = given[given.n > n]
            continue
        a = stack(level.coef, width)
        from_above = given[given.n == n]
        if len(from_above):
            at = level[TREE_KEY].merge(from_above[TREE_KEY].assign(at=np.arange(len(from_above))), on=TREE_KEY, how="left")["at"].to_numpy(float)
            hit = np.flatnonzero(~np.isnan(at))
            s = stack(from_above.coef, mra.size)[at[hit].astype(int)]
            a[hit, : mra.size] = s + (a[hit, : mra.size] if add else 0)
        out.append(level[[*TREE_KEY, "is_end"]].assign(coef=list(a), given=False))
        inner = np.flatnonzero(~level.is_end.to_numpy(bool))
        if len(inner):
            s = B.reconstruct(a[inner], mra.dim, mra.k, mra.basis).reshape(-1, mra.size)
            keys = level[TREE_KEY].iloc[np.repeat(inner, mra.blocks)].reset_index(drop=True)
            keys["n"] += 1
            for d in range(mra.dim):
                keys[AXES[d]] = 2 * keys[AXES[d]] + np.tile(steps[:, d], len(inner))
            given = pd.concat([given, keys.assign(is_end=False, coef=list(s), given=True)], ignore_index=True)
    left = given[given.n == bottom]
    return pd.concat([*out, left[[*TREE_KEY, "is_end", "coef", "given"]]], ignore_index=True) if out or len(left) else pdf.iloc[:0][[*TREE_KEY, "is_end", "coef", "given"]]


def _descend_to(mra: MRA, bottom: int, add: bool):
    return lambda pdf: _descend(pdf, mra, bottom, add)


def reconstruct_down(nodes: DataFrame, mra: MRA, add: bool = False) -> DataFrame:
    """Scaling blocks of every node from the wavelets above it; with add, on top of what it has."""
    nodes = write_shared(nodes.select(*TREE_KEY, "is_end", "coef", F.lit(False).alias("given")))
    count = {r[0]: r[1] for r in nodes.groupBy("n").count().collect()}
    if not count:
        return with_norms(nodes.drop("given"), mra)
    top, last, height = min(count), max(count), band_height(mra.dim)
    given, out, passed = None, None, 0
    while top <= last:
        bottom = min(last + 1, top + height)
        band = nodes.where((F.col("n") >= top) & (F.col("n") < bottom))
        rows = sum(c for n, c in count.items() if top <= n < bottom) + passed
        task = _subtree(top, 1 + rows // NODES_PER_TASK)
        both = band if given is None else band.unionByName(given)
        band = write_shared(both.groupBy(task).applyInPandas(_descend_to(mra, bottom, add), f"{NODE}, given boolean"))
        done = band.where("not given").drop("given")
        out = done if out is None else out.unionByName(done)
        given, top = band.where("given"), bottom
        passed = given.count() if top <= last else 0
    return with_norms(out, mra)


def max_norms(nodes: DataFrame, mra: MRA) -> DataFrame:
    """(key, max_sq, max_w): largest 2^(Dn) square norm and wavelet square norm in each node's subtree."""
    w = F.aggregate(F.slice("comp_norm", 2, mra.blocks), F.lit(0.0), lambda a, x: a + x * x)
    scaled = nodes.select(*TREE_KEY, (F.col("sq_norm") * F.pow(F.lit(2.0), F.col("n") * mra.dim)).alias("q"), (w * F.pow(F.lit(2.0), F.col("n") * mra.dim)).alias("w"))
    up = ancestors(scaled, mra.world.scale)
    return up.groupBy("tree_id", F.col("an").alias("n"), *[F.col("a" + a[1]).alias(a) for a in AXES]).agg(F.max("q").alias("max_sq"), F.max("w").alias("max_w"))


def leaf_values(leaves: DataFrame, mra: MRA) -> DataFrame:
    """(key, values): function values at the quadrature points of each leaf's children."""

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        return keys_of(pdf).assign(values=list(to_values(a, pdf.n.to_numpy(), mra)))

    return map_coefs(leaves, "tree_id string, n int, lx int, ly int, lz int, values array<double>", run, mra.blocks * mra.size)


def to_values(a: np.ndarray, n: np.ndarray, mra: MRA) -> np.ndarray:
    s = B.reconstruct(a, mra.dim, mra.k, mra.basis).reshape(-1, mra.size)
    return B.coefs_to_values(s, mra.dim, mra.k, mra.basis, np.repeat(n + 1, mra.blocks), mra.world.volume_factor).reshape(len(a), -1)


def from_values(v: np.ndarray, n: np.ndarray, mra: MRA) -> np.ndarray:
    s = B.values_to_coefs(v.reshape(-1, mra.size), mra.dim, mra.k, mra.basis, np.repeat(n + 1, mra.blocks), mra.world.volume_factor)
    return B.compress(s.reshape(len(v), -1), mra.dim, mra.k, mra.basis)


def set_leaf_values(values: DataFrame, mra: MRA) -> DataFrame:
    """The tree whose leaves have these values at the quadrature points of their children."""

    def run(pdf: pd.DataFrame, v: np.ndarray) -> pd.DataFrame:
        return keys_of(pdf).assign(is_end=True, coef=list(from_values(v, pdf.n.to_numpy(), mra)))

    return rebuild(map_coefs(values, NODE, run, mra.blocks * mra.size, "values"), mra)


__all__ = ["KEY", "child_scaling", "compress_up", "from_values", "leaf_values", "map_at_cells", "max_norms", "push_down", "rebuild", "reconstruct_down", "set_leaf_values", "to_values"]
