"""Hard-negative mining by cover trees over norm-augmented candidates.

Candidates are dealt once to blocks of bounded size: rows of a label with more than a block's rows fill blocks of their
own, other labels share blocks, as a hash says. A task builds a cover tree over its block. Every candidate gets one
more coordinate, so that all lie on a sphere whose radius is the block's longest norm; anchors get 0 there, so inner
products stay as they are. A node covers its points within a radius that shrinks from level to level; the angle between
anchor and node's centre, widened and narrowed by the angle of that radius, bounds the products of all points below.
The descent takes the node with the highest bound first, passes over nodes that lie outside of all of an anchor's windows
or below what is found already, and takes exact integer products of the points at the leaves. The anchors, a hundredth of
all rows, are copied to blocks; a first pass over the blocks of their label finds positives, a second one negatives.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no part; shorter vectors are padded
with zeros. Repeated ids are rows of their own: an anchor's others are all rows but itself, each anchor row is mined, and ties
of score and id go by label, then arbitrarily among equal rows. Scores beyond a long are clipped to it. A positive with fewer
than k negatives gives fewer rows, an empty table gives none; only id, vector and label are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mwspark.llm.common import cut, table
from mwspark.llm.topk import best, matrix, products

K_POSITIVES = 5
K_NEGATIVES = 5
BLOCK = 8192
ANCHORS = 32768
LEAF = 128
SHRINK = 0.75
WIDEST = 1.2  # covering radius of the first level, in radii of the sphere
LEAST = 8  # fewer points stay with their node
ALONE = 48  # so many small groups in a row end a level
FAR = float(2**62)


class CoverTree:
    """Nodes as arrays: centre, angle of the covering radius, children, and points that no child covers."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        norms2 = (points * points).sum(1)
        self.radius = float(np.sqrt(norms2.max(initial=0)))
        on_sphere = np.hstack([points, np.sqrt(np.maximum(self.radius**2 - norms2, 0))[:, None]])
        self.centres: list[np.ndarray] = []
        self.angles: list[float] = []
        self.children: list[list[int]] = []
        self.own: list[np.ndarray] = []
        todo = [(-1, np.random.default_rng(0).permutation(len(points)), WIDEST * self.radius / SHRINK)] if len(points) else []
        while todo:
            parent, at, cover = todo.pop()
            here = on_sphere[at]
            centre = here.mean(0) if parent < 0 else here[0]
            far = np.sqrt(((here - centre) ** 2).sum(1))
            radius = float(far.max())
            node = len(self.centres)
            self.centres.append(centre[:-1])
            self.angles.append(self.angle_of(centre, radius))
            self.children.append([])
            self.own.append(at)
            if parent >= 0:
                self.children[parent].append(node)
            if len(at) <= leaf or radius <= 1e-9 * self.radius:
                continue
            cover = cover * SHRINK if parent < 0 else min(cover, radius) * SHRINK  # the next level's covering radius
            left, rest, alone = np.arange(len(at)), [], 0
            while len(left) and alone < ALONE:  # points that are alone at this level stay with the node
                near = ((here[left] - here[left[0]]) ** 2).sum(1) <= cover * cover
                group, left = left[near], left[~near]
                if len(group) < LEAST:
                    rest.append(group)
                    alone += 1
                else:
                    todo.append((node, at[group], cover))
                    alone = 0
            self.own[node] = at[np.concatenate([*rest, left])] if rest or len(left) else at[:0]
        self.centre = np.array(self.centres).reshape(len(self.centres), points.shape[1])
        self.angle = np.array(self.angles)

    def angle_of(self, centre: np.ndarray, radius: float) -> float:
        """How far, as an angle on the sphere, points within radius of centre can be from it; pi if centre isn't on the sphere."""
        if self.radius == 0 or abs(float(np.sqrt((centre * centre).sum())) - self.radius) > 1e-9 * self.radius:
            return np.pi
        return 2 * float(np.arcsin(min(1.0, radius / (2 * self.radius)))) + 1e-7

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible product of each anchor with the points under each node."""
        size = np.sqrt((anchors * anchors).sum(1))[:, None] * self.radius
        with np.errstate(all="ignore"):
            theta = np.arccos(np.clip(np.where(size > 0, anchors @ self.centre.T / size, 0), -1, 1))
        slack = 1 + 1e-7 * size
        return size * np.cos(np.minimum(np.pi, theta + self.angle)) - slack, size * np.cos(np.maximum(0, theta - self.angle)) + slack


def descend(tree: CoverTree, low: np.ndarray, high: np.ndarray, windows: list[tuple[float, float]], score, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and products of the first k points of each window [lo, hi] of products; ties to smaller ids.

    score gives positions and products of those of a node's own points that may be taken.
    """
    none = np.empty(0, int), np.empty(0, np.int64)
    kept = [none] * len(windows)
    least = [lo for lo, _ in windows]  # what a product must reach to be among the first k of its window
    inside = np.zeros(len(high), bool)
    for lo, hi in windows:
        inside |= (low <= hi) & (high >= lo)
    queue = [(-high[0], 0)] if len(high) and inside[0] else []
    while queue:
        bound, node = heapq.heappop(queue)
        if not any(-bound >= x and low[node] <= hi for x, (_, hi) in zip(least, windows, strict=True)):
            continue
        for child in tree.children[node]:
            if inside[child]:
                heapq.heappush(queue, (-high[child], child))
        at, s = score(node)
        for w, (_, hi) in enumerate(windows):
            new = np.flatnonzero((s >= least[w]) & (s <= hi))
            if len(new):
                both = np.concatenate([kept[w][0], at[new]]), np.concatenate([kept[w][1], s[new]])
                first = best(both[1], ids[both[0]], k)
                kept[w] = both[0][first], both[1][first]
                if len(first) == k:
                    least[w] = float(kept[w][1][-1])
    return kept


def mine_block(anchors: pd.DataFrame, block: pd.DataFrame, same_label: bool, k: int, leaf: int = LEAF) -> list[tuple]:
    """(anchor row, anchor id, window, id, label, score) of the first k rows of the block in each of an anchor's windows.

    Windows are the anchors' lists los and his; products of both bounds count.
    """
    dim = max(max((len(v) for v in x.vec), default=0) for x in (anchors, block)) or 1
    A, C = matrix(anchors.vec, dim), matrix(block.vec, dim)
    tree = CoverTree(C, leaf)
    ends = np.cumsum([len(x) for x in tree.own])
    order = np.concatenate(tree.own)  # a node's own points side by side
    C = C[order]
    ids, rows, labels = (block[x].to_numpy(np.int64)[order] for x in ("vec_id", "row", "label"))
    whole = np.abs(A).max(initial=0) * np.abs(C).max(initial=0) * dim < 2**53
    out: list[tuple] = []
    for part in np.array_split(np.arange(len(A)), max(1, len(A) * len(ends) // 1_000_000)):
        low, high = tree.bounds(A[part])
        columns = (anchors[x].iloc[part] for x in ("row", "vec_id", "label", "los", "his"))
        for i, lo_i, hi_i, row, vec_id, label, los, his in zip(part, low, high, *columns, strict=True):

            def score(node: int, q: np.ndarray = A[i : i + 1], label: int = label, row: int = row) -> tuple[np.ndarray, np.ndarray]:
                at = slice(ends[node] - len(tree.own[node]), ends[node])
                s = C[at] @ q[0] if whole else products(q, C[at])[0]
                fits = np.flatnonzero(((labels[at] == label) == same_label) & (rows[at] != row))
                return fits + at.start, s[fits].astype(np.int64)

            found = descend(tree, lo_i, hi_i, list(zip(los, his, strict=True)), score, ids, k)
            for w, (at, s) in enumerate(found):
                out += [(row, vec_id, w, ids[j], labels[j], x) for j, x in zip(at, s, strict=True)]
    return out


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, row (its number), label, vec (array of whole doubles)."""
    d = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = ~F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull() & label.isNotNull()
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), d.alias("vec"))


def mine(
    df: DataFrame, is_anchor: Column, label: Column | None = None, k_positives: int = K_POSITIVES, k_negatives: int = K_NEGATIVES, low: int = 80, high: int = 100,
    scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, anchors: int = ANCHORS, leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a Column over vec_id. Negatives of a positive have low * positive score <= 100 * score <= high * positive score.
    """
    label = F.col("label") if label is None else label
    vecs = cut(whole_numbers(df, id_col, vec_col, label, scale))
    n, dim = vecs.agg(F.count("*"), F.max(F.size("vec"))).first()
    block = max(1, min(block, 4_194_304 // max(1, dim or 1)))  # 32 MB of doubles
    anchors = max(1, min(anchors, 4_194_304 // max(1, dim or 1)))
    # a label of many rows fills blocks of its own, numbered after those that the other labels share
    shared = 1 + n // block
    sizes = vecs.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > block // 2)
    sizes = sizes.withColumn("parts", (1 + F.floor(F.col("size") / block)).cast("int"))
    before = F.sum("parts").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    large = cut(sizes.select("label", "parts", (shared + F.coalesce(before, F.lit(0))).cast("int").alias("first")))
    last = shared + (large.agg(F.sum("parts")).first()[0] or 0) - 1
    number = F.coalesce(F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")), F.pmod(F.xxhash64("label"), F.lit(shared)))
    held = cut(vecs.join(large, "label", "left").withColumn("block", number.cast("int")))
    n_parts = 1 + n // (100 * anchors)
    chosen = cut(held.where(is_anchor).withColumn("qb", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(n_parts)).cast("int")))
    copies = held.select("vec_id", "row", "label", "vec", "block", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("qb"))
    schema = "anchor_row long, anchor_id long, w int, vec_id long, label long, score long"

    def run(qs: DataFrame, same_label: bool, k: int) -> DataFrame:
        def one(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            found = mine_block(q, c, same_label, k, leaf) if len(q) and len(c) else []
            return pd.DataFrame(found, columns=["anchor_row", "anchor_id", "w", "vec_id", "label", "score"]).astype("int64").astype({"w": "int32"})

        qs = qs.select("vec_id", "row", "label", "vec", "los", "his", "block", "qb")
        return qs.groupBy("qb", "block").cogroup(copies.groupBy("qb", "block")).applyInPandas(one, schema)

    # positives: only in the blocks that hold the anchor's label
    homes = F.when(F.col("first").isNotNull(), F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).otherwise(F.array("block"))
    asking = chosen.withColumns({"los": F.array(F.lit(-FAR * 4)), "his": F.array(F.lit(FAR * 4)), "block": F.explode(homes)})
    first = run(asking, True, k_positives)
    at = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id"))
    positives = first.withColumn("p", at - 1).where(F.col("p") < k_positives)
    positives = cut(positives.select("anchor_row", "p", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # negatives: the windows of an anchor's positives, over all blocks but those of its label alone
    exact = F.col("positive_score").cast("decimal(25,0)")
    window = F.struct("p", F.ceil(exact * low / 100).cast("double").alias("lo"), F.floor(exact * high / 100).cast("double").alias("hi"))
    windows = positives.groupBy("anchor_row").agg(F.sort_array(F.collect_list(window)).alias("b"))
    asking = chosen.drop("block").join(windows, F.col("anchor_row") == F.col("row")).withColumns({"los": F.col("b.lo"), "his": F.col("b.hi")})
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    own = F.col("first").isNotNull() & F.col("block").between(F.col("first"), F.col("first") + F.col("parts") - 1)
    second = run(asking.where(~own), False, k_negatives)
    at = F.row_number().over(Window.partitionBy("anchor_row", "w").orderBy(F.desc("score"), "vec_id", "label"))
    second = second.withColumn("rank", at).where(F.col("rank") <= k_negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "anchor_row": "r"})
    out = positives.join(second, (F.col("r") == F.col("anchor_row")) & (F.col("w") == F.col("p")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS r, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
g AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 5
"""
