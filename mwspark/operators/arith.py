"""Arithmetic on trees: sums, products, maps, scaling. Many output functions in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from mwspark.functions.basis import child_steps
from mwspark.functions.shared import write_shared
from mwspark.functions.trees import KEYS, NODE, keys_of, map_coefs, stack, with_norms
from mwspark.mra import AXES, KEY, MRA, TREE_KEY
from mwspark.operators.keys import children, end_nodes, parent_key
from mwspark.operators.project import adaptive
from mwspark.operators.transform import from_values, map_at_cells, rebuild, to_values

NODES_PER_TASK = 4096


def _partial(keys: list[str], width: int, product: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums (or products) by key of the coef arrays of one frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf[[*keys, "coef"]]
        at = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        _, first = np.unique(at, return_index=True)
        total = stack(pdf.coef, width)
        if len(first) < len(at):
            rows, total = total, np.ones((len(first), width)) if product else np.zeros((len(first), width))
            (np.multiply if product else np.add).at(total, at, rows)
        return pdf[keys].iloc[first].reset_index(drop=True).assign(coef=list(total))

    return run


def _by_key(part: DataFrame, keys: list[str], schema: str, width: int, cells: int, product: bool, finish: Callable[[pd.DataFrame], pd.DataFrame] = lambda pdf: pdf) -> DataFrame:
    """finish of the sums (or products) by key of partial ones, by a hash of the key."""
    tasks, total = 1 + cells // NODES_PER_TASK, _partial(keys, width, product)
    return part.groupBy(F.pmod(F.xxhash64(*keys), F.lit(tasks))).applyInPandas(lambda pdf: finish(total(pdf)), schema)


def sum_arrays(rows: DataFrame, keys: list[str], schema: str, width: int, cells: int, product: bool = False) -> DataFrame:
    """Sums (or products) of the coef arrays by key: first in each task, then by a hash of the key, so that no key gathers all its rows."""
    partial = _partial(keys, width, product)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield partial(pdf)

    return _by_key(rows.select(*keys, "coef").mapInPandas(run, schema), keys, schema, width, cells, product)


def union_leaves(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves (tree_id = out_id, n, l..) of the union grid of each output's input trees: its cells that are no cell's parent."""
    cells = nodes.select(*TREE_KEY).join(terms.select("out_id", "tree_id").distinct(), "tree_id").select(F.col("out_id").alias("tree_id"), *KEY)
    both = F.array(F.struct(*KEY, F.lit(False).alias("above")), F.struct(*parent_key(), F.lit(True).alias("above")))
    marked = cells.select("tree_id", F.explode(both).alias("x")).select("tree_id", "x.*")
    return marked.groupBy(*TREE_KEY).agg(F.max("above").alias("above")).where("not above").select(*TREE_KEY)


def _wanted(cells: DataFrame, terms: DataFrame) -> DataFrame:
    """(tree_id, key, and what else terms have): every input tree of each output with the output's cells."""
    return cells.select(F.col("tree_id").alias("out_id"), *KEY).join(terms, "out_id").select(*TREE_KEY, *[c for c in terms.columns if c != "tree_id"])


def _on_cells(cells: DataFrame, terms: DataFrame, nodes: DataFrame, mra: MRA) -> DataFrame:
    """(out_id, tree_id, key, coef): every input tree of each output at the output's cells."""
    return lookup(nodes, _wanted(cells, terms.select("out_id", "tree_id").distinct()), mra)


def lookup(nodes: DataFrame, target: DataFrame, mra: MRA) -> DataFrame:
    """(key, what else target has, coef) of existing nodes, and generated ones below leaves."""
    kinds = StructType([*target.schema.fields, StructField("coef", ArrayType(DoubleType()))])
    return map_at_cells(nodes, target, mra, kinds, lambda pdf, a: pdf[kinds.names[:-1]].assign(coef=list(a)))


def _meet(level: DataFrame, own: DataFrame, nodes: DataFrame, mra: MRA, cells: int, term: Callable[[pd.DataFrame, np.ndarray], np.ndarray], product: bool, finish: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """New leaves at level's cells (tree_id = out_id): finish of the sum or product over own(out_id, tree_id, ..) of term, for many rows at once."""
    width, partial = mra.blocks * mra.size, _partial(TREE_KEY, mra.blocks * mra.size, product)

    def first(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        return partial(pdf[["out_id", *KEY]].set_axis(TREE_KEY, axis=1).assign(coef=list(term(pdf, a))))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return keys_of(pdf).assign(is_end=True, coef=list(finish(pdf, stack(pdf.coef, width))))

    part = map_at_cells(nodes, _wanted(level, own), mra, f"{KEYS}, coef array<double>", first)
    return _by_key(part, TREE_KEY, NODE, width, cells, product, last)


def add(terms: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0, max_iter: int = -1, abs_prec: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Sums out_id = sum of c * tree over terms(out_id, tree_id, c), on the union grid or, with prec, adaptively from start.

    The inputs are looked up at the cells once; each task adds up what it has, then a hash of the cell deals the partial sums.
    """
    own = write_shared(terms.groupBy("out_id", "tree_id").agg(F.sum("c").alias("c")))
    cells = write_shared(union_leaves(own, nodes) if start is None else start)
    n = cells.count()

    def calc(level: DataFrame) -> DataFrame:
        return _meet(level, own, nodes, mra, n, lambda pdf, a: a * pdf.c.to_numpy(float)[:, None], False, lambda pdf, a: a)

    return adaptive(cells, calc, mra, prec, max_iter, abs_prec)


def multiply(terms: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0, max_iter: int = -1, abs_prec: bool = False, extra: int = 1) -> DataFrame:
    """Pointwise products out_id = c * A * B over terms(out_id, a_id, b_id, c), from the union grid split extra times."""
    both = terms.select("out_id", F.col("a_id").alias("tree_id")).union(terms.select("out_id", F.col("b_id").alias("tree_id"))).distinct()
    cells = children(union_leaves(both, nodes), mra.dim, extra).select(*TREE_KEY)

    return adaptive(cells, lambda level: _products(level, both, terms, nodes, mra), mra, prec, max_iter, abs_prec)


def multiply_many(terms: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0, max_iter: int = -1, abs_prec: bool = False, start: DataFrame | None = None, extra: int = 1) -> DataFrame:
    """Pointwise products out_id of all c * tree over terms(out_id, tree_id, c), of any number of factors.

    From start cells (tree_id = out_id, n, l..), or from the union grid of the factors split extra times. A tree that occurs
    more than once is a power. An output with a factor that nodes don't hold is left out. The factors' values meet by cell: each task
    multiplies what it has, then a hash of the cell deals the partial products, so that no output gathers its factors.
    """
    held = nodes.select("tree_id").distinct().withColumn("held", F.lit(True))
    own = write_shared(terms.groupBy("out_id", "tree_id").agg(F.count("*").alias("times"), F.product("c").alias("c")).join(held, "tree_id", "left"))
    lacking = own.where("held is null").select("out_id").distinct()
    if not lacking.isEmpty():
        own = write_shared(own.join(lacking, "out_id", "left_anti"))
    own = own.select("out_id", "tree_id", "times", "c")
    cells = children(union_leaves(own, nodes), mra.dim, extra).select(*TREE_KEY) if start is None else start.join(own.select(F.col("out_id").alias("tree_id")).distinct(), "tree_id", "left_semi").select(*TREE_KEY)
    cells = write_shared(cells)
    n = cells.count()

    def powers(pdf: pd.DataFrame, a: np.ndarray) -> np.ndarray:
        return to_values(a, pdf.n.to_numpy(), mra) ** pdf.times.to_numpy()[:, None] * pdf.c.to_numpy()[:, None]

    def calc(level: DataFrame) -> DataFrame:
        return _meet(level, own, nodes, mra, n, powers, True, lambda pdf, v: from_values(v, pdf.n.to_numpy(), mra))

    return adaptive(cells, calc, mra, prec, max_iter, abs_prec)


def _products(level: DataFrame, both: DataFrame, terms: DataFrame, nodes: DataFrame, mra: MRA) -> DataFrame:
    """Products at the cells of level, through values at the quadrature points of their children."""
    found = _on_cells(level, both, nodes, mra)
    a = found.select("out_id", F.col("tree_id").alias("a_id"), *TREE_KEY[1:], F.col("coef").alias("ca"))
    b = found.select("out_id", F.col("tree_id").alias("b_id"), *TREE_KEY[1:], F.col("coef").alias("cb"))
    j = terms.join(a, ["out_id", "a_id"]).join(b, ["out_id", "b_id", *TREE_KEY[1:]])
    j = j.select(F.col("out_id").alias("tree_id"), *TREE_KEY[1:], "c", "ca", "cb")

    def run(pdf: pd.DataFrame, ca: np.ndarray) -> pd.DataFrame:
        n = pdf.n.to_numpy()
        v = to_values(ca, n, mra) * to_values(stack(pdf.cb, ca.shape[1]), n, mra) * pdf.c.to_numpy()[:, None]
        return keys_of(pdf).assign(is_end=True, coef=list(from_values(v, n, mra)))

    return map_coefs(j, NODE, run, mra.blocks * mra.size, "ca")


def tree_map(nodes: DataFrame, mra: MRA, f: Callable[[np.ndarray], np.ndarray], prec: float = -1.0, max_iter: int = -1, extra: int = 0) -> DataFrame:
    """f of the function's values, pointwise, for every tree of the table; from the leaf grid split extra times."""
    cells = nodes.where("is_end").select(*TREE_KEY)
    if extra:
        cells = children(cells, mra.dim, extra).select(*TREE_KEY)

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        n = pdf.n.to_numpy()
        return keys_of(pdf).assign(is_end=True, coef=list(from_values(f(to_values(a, n, mra)), n, mra)))

    return adaptive(cells, lambda level: map_coefs(lookup(nodes, level, mra), NODE, run, mra.blocks * mra.size), mra, prec, max_iter)


def square(nodes: DataFrame, mra: MRA, prec: float = -1.0, extra: int = 1) -> DataFrame:
    return tree_map(nodes, mra, np.square, prec, extra=extra)


def power(nodes: DataFrame, mra: MRA, p: float, prec: float = -1.0, extra: int = 1) -> DataFrame:
    return tree_map(nodes, mra, lambda v: v**p, prec, extra=extra)


def absadd(nodes: DataFrame, other: DataFrame, mra: MRA, c: float) -> DataFrame:
    """|T|^2 + |c X|^2 in values, on T's grid; other holds X under T's tree_id. (Squares, as in the operator's model.)"""
    ends = nodes.where("is_end").select(*TREE_KEY, "coef")
    j = ends.join(lookup(other, ends.select(*TREE_KEY), mra).withColumnRenamed("coef", "cx"), TREE_KEY)

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        n = pdf.n.to_numpy()
        v = to_values(a, n, mra) ** 2 + (c * to_values(stack(pdf.cx, a.shape[1]), n, mra)) ** 2
        return keys_of(pdf).assign(is_end=True, coef=list(from_values(v, n, mra)))

    return rebuild(map_coefs(j, NODE, run, mra.blocks * mra.size), mra)


def rescale(nodes: DataFrame, c, mra: MRA) -> DataFrame:
    """Every coefficient times c (a number or a Column)."""
    factor = F.lit(c) if isinstance(c, (int, float)) else c
    return with_norms(nodes.select(*TREE_KEY, "is_end", F.transform("coef", lambda x: x * factor).alias("coef")), mra)


def normalize(nodes: DataFrame, mra: MRA) -> DataFrame:
    norm = nodes.where("is_end").groupBy("tree_id").agg(F.sqrt(F.sum("sq_norm")).alias("norm"))
    return rescale(nodes.join(norm, "tree_id"), 1 / F.col("norm"), mra)


def dot_field(pairs: DataFrame, nodes: DataFrame, mra: MRA, prec: float = -1.0) -> DataFrame:
    """Pointwise sums of products over pairs(out_id, d, a_id, b_id, c)."""
    part = F.concat_ws("/", "out_id", F.col("d").cast("string"))
    products = multiply(pairs.select(part.alias("out_id"), "a_id", "b_id", "c"), nodes, mra, prec)
    terms = pairs.select("out_id", part.alias("tree_id"), F.lit(1.0).alias("c"))
    return add(terms, products, mra)


def _renamed(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.withColumn("tree_id", F.concat(F.lit(prefix), "tree_id"))


def add_in_place(nodes: DataFrame, other: DataFrame, mra: MRA, c: float = 1.0) -> DataFrame:
    """T + c X on the union of both grids, for each tree of nodes; other holds X under T's tree_id."""
    ids = nodes.select("tree_id").distinct()
    own = ids.select(F.col("tree_id").alias("out_id"), F.concat(F.lit("T/"), "tree_id").alias("tree_id"), F.lit(1.0).alias("c"))
    theirs = other.select("tree_id").distinct().select(F.col("tree_id").alias("out_id"), F.concat(F.lit("X/"), "tree_id").alias("tree_id"), F.lit(float(c)).alias("c"))
    both = _renamed(nodes.select(*TREE_KEY, "is_end", "coef"), "T/").unionByName(_renamed(other.select(*TREE_KEY, "is_end", "coef"), "X/"))
    return add(own.unionByName(theirs.join(ids.withColumnRenamed("tree_id", "out_id"), "out_id", "left_semi")), both, mra)


def add_in_place_fixed(nodes: DataFrame, other: DataFrame, mra: MRA, c: float = 1.0) -> DataFrame:
    """T + c X on T's own grid."""
    ends = nodes.where("is_end").select(*TREE_KEY, "coef")
    found = lookup(other, ends.select(*TREE_KEY), mra).withColumnRenamed("coef", "cx")
    total = F.when(F.col("cx").isNull(), F.col("coef")).otherwise(F.zip_with("coef", "cx", lambda a, b: a + float(c) * b))
    return rebuild(ends.join(found, TREE_KEY, "left").select(*TREE_KEY, total.alias("coef")), mra)


def multiply_in_place(nodes: DataFrame, other: DataFrame, mra: MRA, c: float = 1.0) -> DataFrame:
    """c T X on T's own grid."""
    ends = nodes.where("is_end").select(*TREE_KEY, "coef")
    j = ends.join(lookup(other, ends.select(*TREE_KEY), mra).withColumnRenamed("coef", "cx"), TREE_KEY)

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        n = pdf.n.to_numpy()
        v = float(c) * to_values(a, n, mra) * to_values(stack(pdf.cx, a.shape[1]), n, mra)
        return keys_of(pdf).assign(is_end=True, coef=list(from_values(v, n, mra)))

    return rebuild(map_coefs(j, NODE, run, mra.blocks * mra.size), mra)


def max_norm_grid(terms: DataFrame, nodes: DataFrame, mra: MRA, prec: float) -> DataFrame:
    """Leaves (tree_id = out_id, n, l..) of the grid of each product of two, judged by norms alone.

    A cell splits where w0 s1 + w1 s0 + w0 w1 > prec, for the largest wavelet norms w and norms s (in units of values) of the
    factors in that cell and below, unless it is a leaf of both. Below a factor's leaf w is 0 and s that of the leaf.
    """
    from mwspark.operators.keys import ancestors, end_node_of
    from mwspark.operators.transform import max_norms

    norms = max_norms(nodes, mra).select(*TREE_KEY, F.sqrt("max_sq").alias("s"), F.sqrt("max_w").alias("w"))
    norms = write_shared(norms.join(nodes.select(*TREE_KEY, "is_end"), TREE_KEY))
    pairs = terms.select("out_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_id").alias("tree_id")), F.struct(F.lit("b").alias("side"), F.col("b_id").alias("tree_id")))).alias("x")).select("out_id", "x.side", "x.tree_id")
    cells = pairs.join(nodes.select(*TREE_KEY), "tree_id").select("out_id", *TREE_KEY[1:]).distinct()
    wanted = write_shared(cells.join(pairs, "out_id"))
    here = wanted.join(norms, TREE_KEY)
    below = wanted.join(norms.select(*TREE_KEY), TREE_KEY, "left_anti")
    found = end_node_of(below, norms.where("is_end").select(*TREE_KEY, "s"), mra.world, tree_key=True)
    cols = ["out_id", "side", *TREE_KEY[1:]]
    both = here.select(*cols, "s", "w", "is_end").unionByName(found.select(*cols, "s", F.lit(0.0).alias("w"), F.lit(True).alias("is_end")))
    side = lambda c, x: F.max(F.when(F.col("side") == x, F.col(c)))
    judged = both.groupBy("out_id", *TREE_KEY[1:]).agg(*[side(c, x).alias(f"{c}_{x}") for c in ("s", "w") for x in "ab"], F.min("is_end").alias("leaf"))
    wants = (F.col("w_a") * F.col("s_b") + F.col("w_b") * F.col("s_a") + F.col("w_a") * F.col("w_b") > prec) & ~F.col("leaf")
    judged = write_shared(judged.select(F.col("out_id").alias("tree_id"), *TREE_KEY[1:], F.coalesce(wants, F.lit(False)).alias("wants")))
    # a cell is reached if all cells above it split
    names = {"an": "n", "ax": "lx", "ay": "ly", "az": "lz"}
    above = ancestors(judged.where("wants").select(*TREE_KEY), mra.world.scale, itself=False)
    stopped = above.join(judged.where("not wants").select("tree_id", *[F.col(v).alias(k) for k, v in names.items()]), ["tree_id", *names], "left_semi").select(*TREE_KEY).distinct()
    split = judged.where("wants").select(*TREE_KEY).join(stopped, TREE_KEY, "left_anti")
    roots = judged.where(F.col("n") == mra.world.scale).select(*TREE_KEY)
    return end_nodes(roots.unionByName(children(split, mra.dim).select(*TREE_KEY)))


def multiply_max_norm(terms: DataFrame, nodes: DataFrame, mra: MRA, prec: float) -> DataFrame:
    """Products of two on the grid that their largest norms call for."""
    both = terms.select("out_id", F.col("a_id").alias("tree_id")).union(terms.select("out_id", F.col("b_id").alias("tree_id"))).distinct()
    return adaptive(write_shared(max_norm_grid(terms, nodes, mra, prec)), lambda level: _products(level, both, terms, nodes, mra), mra)


def multiply_by_function(
    nodes: DataFrame, mra: MRA, f: Callable[[np.ndarray], np.ndarray], refine: int = 0, prec: float = -1.0,
    wants: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, of_f: DataFrame | None = None,
) -> DataFrame:
    """Every tree times f(points[N, D]) -> values[N], each on its own leaf grid refined at most refine times.

    wants(n, low, high) is f's hint: for many cells at once (scales, corners (cells, D)) whether f calls for finer ones; without it all
    are split. Values of f are read from of_f, nodes of a tree of f, where that has the cell, and taken from f elsewhere, once for
    each cell, however many trees own it. prec crops the results.
    """
    from mwspark.operators.grid import crop
    from mwspark.operators.project import cell_points

    ends = nodes.where("is_end").select(*TREE_KEY)
    cell, steps = TREE_KEY[1:], child_steps(mra.dim)

    def refined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            level = pdf[TREE_KEY].reset_index(drop=True)
            for _ in range(refine):
                n = level.n.to_numpy()
                side = 2.0 ** -n.astype(float)[:, None] * np.array(mra.world.sf)
                low = level[list(AXES[: mra.dim])].to_numpy(float) * side
                split = np.broadcast_to(True if wants is None else wants(n, low, low + side), len(level)) & (n + 2 <= mra.max_scale)
                yield level[~split]
                inner = np.flatnonzero(split)
                level = level.iloc[np.repeat(inner, mra.blocks)].reset_index(drop=True)
                level["n"] += 1
                for d in range(mra.dim):
                    level[AXES[d]] = 2 * level[AXES[d]] + np.tile(steps[:, d], len(inner))
            yield level

    if refine:
        ends = ends.mapInPandas(refined, "tree_id string, n int, lx int, ly int, lz int")
    ends = write_shared(ends)
    kinds = "n int, lx int, ly int, lz int, fv array<double>"

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = cell_points(pdf, mra)
                yield pdf[cell].assign(fv=list(np.asarray(f(x.reshape(-1, mra.dim)), float).reshape(len(pdf), -1)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf[cell].assign(fv=list(to_values(stack(pdf.coef, mra.blocks * mra.size), pdf.n.to_numpy(), mra)))

    union = ends.select(*cell).distinct()
    if of_f is None:
        values = union.mapInPandas(taken, kinds)
    else:
        held = of_f.select(*cell, "coef")
        values = union.join(held, cell).mapInPandas(read, kinds).unionByName(union.join(held.select(*cell), cell, "left_anti").mapInPandas(taken, kinds))
    j = lookup(nodes, ends, mra).join(values, cell)

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        n = pdf.n.to_numpy()
        return keys_of(pdf).assign(is_end=True, coef=list(from_values(to_values(a, n, mra) * stack(pdf.fv, a.shape[1]), n, mra)))

    out = rebuild(map_coefs(j, NODE, run, mra.blocks * mra.size), mra)
    return out if prec < 0 else crop(out, mra, prec)


__all__ = [
    "absadd", "add", "add_in_place", "add_in_place_fixed", "dot_field", "lookup", "max_norm_grid", "multiply", "multiply_by_function", "multiply_in_place", "multiply_many", "multiply_max_norm",
    "normalize", "power", "rescale", "square", "sum_arrays", "tree_map", "union_leaves",
]
