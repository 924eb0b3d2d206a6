"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length into buckets of similar length, and large buckets are split into blocks.
A first pass scores every query against the block of the longest vectors, which gives each query a lower
bound of its k-th score. In the second pass a (query, block) pair has the local cosine threshold
bound / (|q| * longest vector of the block): above 1 the block is left out for that query; from COORD_FROM
on, coordinate pruning keeps only candidates whose unit vector lies in the range that the query's largest
coordinates allow; below it, only those long enough (length pruning). What is left is scored exactly.

Integers: each component x becomes floor(64 * x). Vectors that are null or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors are padded with zeros. A candidate is every row but
the query's own: rows of one id, repeated ones too, are rows of their own, told apart by a number that is written with them,
and each query row gets its k best. Ties go to smaller ids. Scores beyond a long are clipped to it. An empty table
gives no rows; only id and vector are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mwspark.llm.common import cut, table

K = 20
BLOCK = 4096
COORD_FROM = 0.6
BUCKETS = 16


def whole_numbers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, row (its number), vec (array of whole doubles), norm."""
    d = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 64).cast("double"))
    fine = F.col(vec_col).isNotNull() & ~F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.monotonically_increasing_id().alias("row"), d.alias("vec"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))


def matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vecs), dim))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; whole doubles are exact up to 2^53, longer sums take Python's integers."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def search_block(q: pd.DataFrame, c: pd.DataFrame, k: int, coord_from: float) -> list[tuple]:
    """(query row, query id, candidate, score) of the best k of one block for each query, pruned by each query's bound."""
    dim = max(max((len(v) for v in x.vec), default=0) for x in (q, c)) or 1
    Q, C = matrix(q.vec, dim), matrix(c.vec, dim)
    ids, rows, norms = c.vec_id.to_numpy(np.int64), c.row.to_numpy(np.int64), c.norm.to_numpy(float)
    longest = norms.max(initial=0)
    unit = C / np.maximum(norms, 1e-300)[:, None]
    bound, qnorm, qids = q.bound.to_numpy(float), q.norm.to_numpy(float), q.vec_id.to_numpy(np.int64)
    qrows = q.row.to_numpy(np.int64)
    with np.errstate(all="ignore"):
        local = np.where((qnorm > 0) & (longest > 0), bound / (qnorm * longest), np.where(bound > 0, np.inf, -np.inf))
    out: list[tuple] = []
    plain = np.flatnonzero(local < coord_from)  # by length alone, in one product
    for at in np.array_split(plain, max(1, len(plain) // 512)):
        scores = products(Q[at], C)
        for i, s in zip(at, scores, strict=True):
            fits = np.flatnonzero((rows != qrows[i]) & ((norms * qnorm[i] >= bound[i] * (1 - 1e-9)) | (bound[i] <= 0)) & (s >= bound[i]))
            keep = fits[best(s[fits], ids[fits], k)]
            out += zip([qrows[i]] * len(keep), [qids[i]] * len(keep), ids[keep], s[keep], strict=True)
    for i in np.flatnonzero((local >= coord_from) & (local <= 1 + 1e-9)):
        u, t = Q[i] / qnorm[i], min(1.0, local[i])
        fits = np.flatnonzero(norms * qnorm[i] >= bound[i] * (1 - 1e-9))
        for f in np.argsort(-np.abs(u))[:4]:
            slack = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - t * t))) + 1e-9
            x = unit[fits, f]
            low = u[f] * t - slack if u[f] > -t else -1.0  # the range of cosines in [t, 1], not of t alone
            high = u[f] * t + slack if u[f] < t else 1.0
            fits = fits[(x >= low - 1e-9) & (x <= high + 1e-9)]
        s = products(Q[i : i + 1], C[fits])[0]
        good = (rows[fits] != qrows[i]) & (s >= bound[i])
        fits, s = fits[good], s[good]
        keep = best(s, ids[fits], k)
        out += zip([qrows[i]] * len(keep), [qids[i]] * len(keep), ids[fits][keep], s[keep], strict=True)
    return out


def top_k(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, coord_from: float = COORD_FROM) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where is_query holds (a Column over vec_id), the k best others."""
    vecs = cut(whole_numbers(df, id_col, vec_col))
    n = vecs.count()
    cuts = vecs.approxQuantile("norm", [i / BUCKETS for i in range(1, BUCKETS)], 0.01) if n else []
    bucket = sum((F.col("norm") > x).cast("int") for x in sorted(set(cuts))) if cuts else F.lit(0)
    split = 1 + n // (BUCKETS * block)
    cands = vecs.withColumn("bucket", bucket.cast("int")).withColumn("blk", F.pmod(F.xxhash64("row"), F.lit(split)).cast("int"))
    cands = cut(cands)
    groups = cands.groupBy("bucket", "blk").agg(F.max("norm").alias("longest"))
    q_parts = 1 + n // (20 * block)
    queries = vecs.where(is_query).withColumn("qb", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(q_parts)).cast("int"))
    schema = "query_row long, query_id long, vec_id long, score long"

    def run(qs: DataFrame, cs: DataFrame) -> DataFrame:
        def one(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            found = search_block(q, c, k, coord_from) if len(q) and len(c) else []
            return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

        keys = ["qb", "bucket", "blk"]
        qs = qs.select(*[F.col(x).alias(x) for x in qs.columns])  # both sides come from the same tables
        return qs.groupBy(*keys).cogroup(cs.groupBy(*keys)).applyInPandas(one, schema)

    # pass 1: the block of the longest vectors bounds each query's k-th score from below
    top = groups.orderBy(F.desc("longest"), "bucket", "blk").select("bucket", "blk").first() or (0, 0)
    qparts = F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("qb")
    first_q = queries.withColumn("bound", F.lit(float(-(2**63)))).withColumns({"bucket": F.lit(top[0]), "blk": F.lit(top[1])})
    first = run(first_q, cands.where((F.col("bucket") == top[0]) & (F.col("blk") == top[1])).select("*", qparts))
    bounds = first.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("low"))
    queries = cut(queries.join(bounds, F.col("query_row") == F.col("row"), "left").select("vec_id", "row", "vec", "norm", "qb", F.coalesce(F.col("low").cast("double"), F.lit(float(-(2**63)))).alias("bound")))
    # pass 2: blocks that no query of a part can use are left out before anything is copied
    reach = queries.groupBy("qb").agg(F.min(F.when(F.col("bound") > 0, F.col("bound") / F.greatest(F.col("norm"), F.lit(1e-300))).otherwise(0.0)).alias("least"))
    pairs = cut(groups.select("*", qparts).join(reach, "qb").where(F.col("longest") * (1 + 1e-9) >= F.col("least")).select("qb", "bucket", "blk"))
    found = run(queries.join(pairs, "qb"), cands.join(pairs, ["bucket", "blk"]))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
