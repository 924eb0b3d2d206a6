"""Integrals, norms, inner products, evaluation and statistics of trees."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mwspark.functions import basis as B
from mwspark.functions.trees import map_coefs, stack
from mwspark.mra import AXES, COORDS, MRA, TREE_KEY, World
from mwspark.operators.keys import end_node_of, in_world, point_key


def _dot(a: str | Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def integrate(nodes: DataFrame, mra: MRA) -> DataFrame:
    """(tree_id, integral), from the roots' scaling coefficients alone."""
    w = F.array(*[F.lit(float(x)) for x in B.integral_weights(mra.dim, mra.k, mra.basis)])
    one = _dot(F.slice("coef", 1, mra.size), w) * F.pow(F.lit(2.0), -0.5 * mra.dim * F.col("n")) * float(np.sqrt(mra.world.volume_factor))
    return nodes.where(F.col("n") == mra.world.scale).groupBy("tree_id").agg(F.sum(one).alias("integral"))


def integrate_side(nodes: DataFrame, mra: MRA, d: int, positive: bool) -> DataFrame:
    """As integrate, over the root boxes at the upper or lower bound of dimension d."""
    edge = mra.world.corner[d] + (mra.world.boxes[d] - 1 if positive else 0)
    return integrate(nodes.where(F.col(AXES[d]) == edge), mra)


def integrate_end_nodes(nodes: DataFrame, mra: MRA, g: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(tree_id, integral) of g by quadrature on the leaf grid of each tree."""
    from mwspark.operators.project import cell_points

    _, w = B.lattice(mra.dim, mra.k)
    weight = np.tile(w, mra.blocks) / mra.blocks * mra.world.volume_factor

    def run(frames):
        for pdf in frames:
            if len(pdf):
                x = cell_points(pdf, mra)
                v = g(x.reshape(-1, mra.dim)).reshape(len(pdf), -1) @ weight
                yield pd.DataFrame({"tree_id": pdf.tree_id, "v": v * 2.0 ** (-mra.dim * pdf.n.to_numpy(float))})

    cells = nodes.where("is_end").select(*TREE_KEY)
    return cells.mapInPandas(run, "tree_id string, v double").groupBy("tree_id").agg(F.sum("v").alias("integral"))


def square_norm(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_end").groupBy("tree_id").agg(F.sum("sq_norm").alias("square_norm"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Nodes, end nodes and kB of coefficients by tree and scale, with totals (null) in one pass."""
    return nodes.rollup("tree_id", "n").agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_end").cast("int")).alias("n_end"), (F.sum(F.size("coef")) * 8 / 1024).alias("kb"))


def dot_pairs(pairs: DataFrame, bra: DataFrame, ket: DataFrame, mra: MRA) -> DataFrame:
    """(bra_id, ket_id, dot) of the pairs: over nodes in both trees, wavelets everywhere and scaling parts at roots."""
    b = bra.select(F.col("tree_id").alias("bra_id"), *TREE_KEY[1:], F.col("coef").alias("cb"))
    k = ket.select(F.col("tree_id").alias("ket_id"), *TREE_KEY[1:], F.col("coef").alias("ck"))
    j = pairs.join(b, "bra_id").join(k, ["ket_id", *TREE_KEY[1:]])
    first = F.when(F.col("n") == mra.world.scale, 1).otherwise(mra.size + 1)
    rest = F.lit(mra.blocks * mra.size)
    return j.groupBy("bra_id", "ket_id").agg(F.sum(_dot(F.slice("cb", first, rest), F.slice("ck", first, rest))).alias("dot"))


def node_norm_dot(pairs: DataFrame, bra: DataFrame, ket: DataFrame, mra: MRA) -> DataFrame:
    """(bra_id, ket_id, bound): sum over bra's leaves of norms, the ket's norm below its own leaf scaled by 2^(-D dn / 2)."""
    ends = bra.where("is_end").select(F.col("tree_id").alias("bra_id"), *TREE_KEY[1:], F.sqrt("sq_norm").alias("nb")).join(pairs, "bra_id")
    keys = ends.select("bra_id", F.col("ket_id").alias("tree_id"), *TREE_KEY[1:], "nb")
    inside = keys.join(ket.select(*TREE_KEY, F.sqrt("sq_norm").alias("nk")), TREE_KEY)
    below = end_node_of(keys, ket.where("is_end").select(*TREE_KEY, F.sqrt("sq_norm").alias("nk")), mra.world, tree_key=True).where("en < n")
    below = below.select(*inside.columns[:0], *[c for c in inside.columns if c != "nk"], (F.col("nk") * F.pow(F.lit(2.0), -0.5 * mra.dim * (F.col("n") - F.col("en")))).alias("nk"))
    both = inside.unionByName(below)
    return both.groupBy("bra_id", F.col("tree_id").alias("ket_id")).agg(F.sum(F.col("nb") * F.col("nk")).alias("bound"))


def node_norm_dot_exact(pairs: DataFrame, bra: DataFrame, ket: DataFrame, mra: MRA) -> DataFrame:
    """(bra_id, ket_id, bound) on one grid: both functions' values are squared in each leaf, and the squared products of the coefficients of these squares are summed."""
    from mwspark.operators.transform import from_values, to_values

    b = bra.where("is_end").select(F.col("tree_id").alias("bra_id"), *TREE_KEY[1:], F.col("coef").alias("cb"))
    k = ket.where("is_end").select(F.col("tree_id").alias("ket_id"), *TREE_KEY[1:], F.col("coef").alias("ck"))
    j = pairs.join(b, "bra_id").join(k, ["ket_id", *TREE_KEY[1:]])

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        n = pdf.n.to_numpy()
        squared = [from_values(to_values(x, n, mra) ** 2, n, mra) for x in (a, stack(pdf.ck, a.shape[1]))]
        return pdf[["bra_id", "ket_id"]].assign(part=((squared[0] * squared[1]) ** 2).sum(1))

    parts = map_coefs(j, "bra_id string, ket_id string, part double", run, mra.blocks * mra.size, "cb")
    return parts.groupBy("bra_id", "ket_id").agg(F.sum("part").alias("bound"))


def evaluate(points: DataFrame, nodes: DataFrame, mra: MRA, precise: bool = False) -> DataFrame:
    """(pid, tree_id, value) at points (pid, tree_id, x, ..): the scaling part of the leaf that holds the point.

    precise reconstructs one level below the leaf first. Points outside a world that is not periodic get 0.
    """
    ends = nodes.where("is_end")
    deepest = ends.agg(F.max("n")).first()[0]
    if deepest is None:
        return points.select("pid", "tree_id", F.lit(0.0).alias("value"))
    keyed = points.select("pid", "tree_id", *[in_world(F.col(COORDS[d]), mra.world, d).alias(f"u{d}") for d in range(mra.dim)], *point_key(mra.world, deepest))
    j = end_node_of(keyed, ends.select(*TREE_KEY, "coef"), mra.world, tree_key=True)

    def run(pdf: pd.DataFrame, a: np.ndarray) -> pd.DataFrame:
        n = pdf.en.to_numpy(float)
        u = pdf[[f"u{d}" for d in range(mra.dim)]].to_numpy() * 2.0 ** n[:, None] - pdf[["ex", "ey", "ez"][: mra.dim]].to_numpy()
        s = a[:, : mra.size]
        if precise:
            kids = B.reconstruct(a, mra.dim, mra.k, mra.basis).reshape(len(a), mra.blocks, mra.size)
            bit = (u >= 0.5).astype(int)
            s, u, n = kids[np.arange(len(a)), (bit << np.arange(mra.dim)).sum(1)], 2 * u - bit, n + 1
        return pd.DataFrame({"pid": pdf.pid, "tree_id": pdf.tree_id, "value": B.evaluate(s, u, mra.dim, mra.k, mra.basis, n, mra.world.volume_factor)})

    found = map_coefs(j, "pid long, tree_id string, value double", run, mra.blocks * mra.size)
    return points.select("pid", "tree_id").join(found, ["pid", "tree_id"], "left").select("pid", "tree_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def lattice_points(nodes: DataFrame, trees: list[str], origin: list[float], sides: list[list[float]], counts: list[int]) -> DataFrame:
    """Points O + i A / (n - 1) + j B / (m - 1) + .. of a line, surface or cube, for each tree."""
    spark = nodes.sparkSession
    total = int(np.prod(counts))
    p = spark.range(total).select(F.col("id").alias("pid"))
    rest, at = F.col("pid"), []
    for c in counts:
        at.append((rest % c) / max(1, c - 1))
        rest = F.floor(rest / c)
    cols = [sum((t * s[d] for t, s in zip(at, sides, strict=True)), F.lit(float(o))).alias(COORDS[d]) for d, o in enumerate(origin)]
    return p.select("pid", F.explode(F.array(*map(F.lit, trees))).alias("tree_id"), *cols)


def grid_cells(nodes: DataFrame, world: World) -> DataFrame:
    """Bounds of the roots and leaves, for drawing."""
    from mwspark.operators.keys import node_bounds

    return nodes.where((F.col("n") == world.scale) | F.col("is_end")).select(*TREE_KEY, "is_end", *node_bounds(world))


__all__ = ["dot_pairs", "evaluate", "grid_cells", "integrate", "integrate_end_nodes", "integrate_side", "lattice_points", "node_norm_dot", "node_norm_dot_exact", "square_norm", "stack", "tree_stats"]
