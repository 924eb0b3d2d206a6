"""Grids: tables of cells (tree_id, n, l..), their union, refinement and pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mwspark.functions import gaussians as G
from mwspark.functions.trees import wavelet_square, with_norms, write_shared
from mwspark.mra import KEY, MRA, TREE_KEY
from mwspark.operators.keys import ancestors, children, end_nodes, node_bounds, parent_key
from mwspark.operators.project import start_grid, threshold
from mwspark.operators.transform import child_scaling


def build_uniform(grid: DataFrame, mra: MRA, scales: int) -> DataFrame:
    """The end cells of the grid, each split so many times."""
    return children(end_nodes(grid).select(*TREE_KEY), mra.dim, scales).select(*TREE_KEY)


def build_gaussian(gaussians: DataFrame, mra: MRA) -> DataFrame:
    """For every function the grid that its terms call for: a cell splits while a term isn't visible and not zero there."""
    grid = start_grid(gaussians.select(F.col("fn_id").alias("tree_id")).distinct(), mra)
    terms = gaussians.withColumnRenamed("fn_id", "tree_id")
    out = grid.select(*TREE_KEY)
    front = out
    for _ in range(mra.max_depth):
        seen = front.join(terms, "tree_id").select("*", *node_bounds(mra.world))
        split = seen.where(~G.visible(mra.k + 1, mra.dim) & ~G.zero_on_cell(mra.dim)).select(*TREE_KEY).distinct()
        front = write_shared(children(split, mra.dim).select(*TREE_KEY))
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def union_grid(grids: list[DataFrame], tree_id: str | None = None) -> DataFrame:
    """All cells of the grids; with tree_id as one grid of that name."""
    cells = reduce(DataFrame.unionByName, [g.select(*TREE_KEY) for g in grids])
    return (cells if tree_id is None else cells.withColumn("tree_id", F.lit(tree_id))).distinct()


def extend_grid(cells: DataFrame, others: DataFrame, mra: MRA, max_iter: int = -1) -> DataFrame:
    """The grid cells with whatever cell others (under the same tree_id) have, at most max_iter scales below the old leaves; -1: all.

    An old leaf above a new cell is found by an equi-join over the cell's ancestors.
    """
    old = cells.select(*TREE_KEY)
    new = others.select(*TREE_KEY).distinct().join(old, TREE_KEY, "left_anti")
    if max_iter >= 0:
        ends = end_nodes(old).select("tree_id", F.col("n").alias("an"), *[F.col(a).alias("a" + a[1]) for a in KEY[1:]])
        up = ancestors(new, mra.world.scale, itself=False).where(F.col("n") - F.col("an") <= max_iter)
        new = up.join(ends, ["tree_id", "an", "ax", "ay", "az"], "left_semi").select(*TREE_KEY)
    return old.unionByName(new).distinct()


def copy_grid(nodes: DataFrame, tree_id: str | None = None) -> DataFrame:
    out = nodes.select(*TREE_KEY)
    return out if tree_id is None else out.withColumn("tree_id", F.lit(tree_id))


def refine_uniform(nodes: DataFrame, mra: MRA, scales: int = 1) -> DataFrame:
    """Every leaf split so many times, the function unchanged."""
    for _ in range(scales):
        nodes = _split(nodes, nodes.where("is_end").select(*TREE_KEY), mra)
    return nodes


def _split(nodes: DataFrame, cells: DataFrame, mra: MRA) -> DataFrame:
    """The tree with these leaves split; children have no wavelets."""
    marked = nodes.join(cells.select(*TREE_KEY, F.lit(True).alias("cut")), TREE_KEY, "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    zeros = F.array_repeat(F.lit(0.0), (mra.blocks - 1) * mra.size)
    new = child_scaling(nodes.join(cells, TREE_KEY, "left_semi"), mra).select(*TREE_KEY, F.lit(True).alias("is_end"), F.concat("s", zeros).alias("coef"))
    old = marked.select(*TREE_KEY, (F.col("is_end") & ~F.col("cut")).alias("is_end"), "coef")
    return with_norms(old.unionByName(new), mra)


def refine_adaptive(nodes: DataFrame, mra: MRA, prec: float, abs_prec: bool = False) -> tuple[DataFrame, int]:
    """One adaptive split step, and the number of new nodes."""
    norm = nodes.where("is_end").groupBy("tree_id").agg(F.sqrt(F.sum("sq_norm")).alias("t"))
    ends = nodes.where("is_end").join(norm, "tree_id")
    t = F.lit(1.0) if abs_prec else F.col("t")
    cells = ends.where((F.sqrt(wavelet_square()) > threshold(prec, t, F.col("n"))) & (F.col("n") + 2 <= mra.max_scale) & F.lit(prec > 0)).select(*TREE_KEY)
    cells = write_shared(cells)
    return _split(nodes, cells, mra), cells.count() * mra.blocks


def refine_like(nodes: DataFrame, other: DataFrame, mra: MRA) -> DataFrame:
    """One split step of the leaves that the other tree of the same id has split."""
    parents = other.select("tree_id", *parent_key()).distinct()
    return _split(nodes, nodes.where("is_end").select(*TREE_KEY).join(parents, TREE_KEY, "left_semi"), mra)


def refine_by_gaussians(nodes: DataFrame, gaussians: DataFrame, mra: MRA) -> tuple[DataFrame, int]:
    """One split step of the leaves where a term of the function (fn_id = tree_id) isn't visible and not zero; and the number of new nodes."""
    ends = nodes.where("is_end").select(*TREE_KEY)
    seen = ends.join(gaussians.withColumnRenamed("fn_id", "tree_id"), "tree_id").select("*", *node_bounds(mra.world))
    wants = ~G.visible(mra.k + 1, mra.dim) & ~G.zero_on_cell(mra.dim) & (F.col("n") + 2 <= mra.max_scale)
    cells = write_shared(seen.where(wants).select(*TREE_KEY).distinct())
    return _split(nodes, cells, mra), cells.count() * mra.blocks


def closure(nodes: DataFrame, cells: DataFrame, mra: MRA) -> DataFrame:
    """The least grid that holds the nodes and the cells: whatever stands above a cell is split."""
    up = ancestors(cells.select(*TREE_KEY), mra.world.scale, itself=False)
    above = up.select("tree_id", F.col("an").alias("n"), *[F.col("a" + a[1]).alias(a) for a in KEY[1:]]).distinct()
    return nodes.select(*TREE_KEY).unionByName(children(above, mra.dim).select(*TREE_KEY)).distinct()


def copy_function(nodes: DataFrame, tree_id: str) -> DataFrame:
    """The same function under another id."""
    return nodes.withColumn("tree_id", F.lit(tree_id))


def project_until(gaussians: DataFrame, mra: MRA, prec: float, most: int = 30) -> DataFrame:
    """Projects on a fixed grid, refines it by precision and projects anew on the finer grid, until a step adds no node."""
    from mwspark.operators.project import project_gaussians

    tree = write_shared(project_gaussians(gaussians, mra, -1.0))
    for _ in range(most):
        finer, new = refine_adaptive(tree, mra, prec)
        if not new:
            break
        tree = write_shared(project_gaussians(gaussians, mra, -1.0, start=finer.where("is_end").select(*TREE_KEY)))
    return tree


def crop(nodes: DataFrame, mra: MRA, prec: float, split_factor: float = 1.0, abs_prec: bool = True) -> DataFrame:
    """Prunes from the leaves up: a node becomes a leaf if a child of it is one and its own wavelets fail the split test."""
    if prec < 0:
        return nodes
    if abs_prec:
        judged = nodes.withColumn("t", F.lit(1.0))
    else:
        judged = nodes.join(nodes.where("is_end").groupBy("tree_id").agg(F.sqrt(F.sum("sq_norm")).alias("t")), "tree_id")
    small = F.sqrt(wavelet_square()) <= threshold(prec, F.col("t"), F.col("n"), split_factor)
    state = write_shared(judged.select(*TREE_KEY, "is_end", small.alias("small")))
    hi = state.agg(F.max("n")).first()[0]
    leaf = state.where("is_end").select(*TREE_KEY)
    cut = leaf.where("false")
    for n in range((hi or 0) - 1, mra.world.scale - 1, -1):
        above = leaf.unionByName(cut).where(F.col("n") == n + 1).select("tree_id", *parent_key()).distinct()
        cut = write_shared(cut.unionByName(state.where((F.col("n") == n) & F.col("small") & ~F.col("is_end")).select(*TREE_KEY).join(above, TREE_KEY, "left_semi")))
    above = ancestors(nodes.select(*TREE_KEY), mra.world.scale, itself=False)
    names = {"an": "n", "ax": "lx", "ay": "ly", "az": "lz"}
    gone = above.join(cut.select("tree_id", *[F.col(v).alias(k) for k, v in names.items()]), ["tree_id", *names], "left_semi").select(*TREE_KEY).distinct()
    kept = nodes.join(gone, TREE_KEY, "left_anti").join(cut.withColumn("now", F.lit(True)), TREE_KEY, "left")
    return kept.withColumn("is_end", F.col("is_end") | F.coalesce("now", F.lit(False))).drop("now")


def clear(nodes: DataFrame) -> DataFrame:
    """The grid with its coefficients dropped."""
    return nodes.select(*TREE_KEY, "is_end", F.lit(None).cast("array<double>").alias("coef"))


def set_zero(nodes: DataFrame, mra: MRA) -> DataFrame:
    zero = F.transform("coef", lambda x: F.lit(0.0))
    return with_norms(nodes.select(*TREE_KEY, "is_end", zero.alias("coef")), mra)


__all__ = ["build_gaussian", "build_uniform", "clear", "closure", "copy_function", "copy_grid", "crop", "extend_grid", "project_until", "refine_adaptive", "refine_by_gaussians", "refine_like", "refine_uniform", "set_zero", "union_grid"]
