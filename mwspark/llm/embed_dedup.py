"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Equal vectors of a label are one class. Each class is rotated by three rounds of random signs and the
fast Hadamard transform; a hash is the signed axis nearest to the rotated vector, HASHES of them make a key,
TABLES keys are made in this way, and each key's PROBES cheapest alternatives are buckets, too. Classes that
meet in any bucket are compared by cosine in double precision. A bucket of more than BLOCK classes is compared
in pairs of blocks. A linked pair is counted in the first of the buckets that both are in, so that the counts
need no pairs as rows; each task gives its counts and a spanning forest of its links, and the forests'
connected components are the groups.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with
nothing; nor do vectors of different lengths. Repeated rows are separate vectors of one class, also if their id
repeats. Ties do not matter. An empty table gives no rows; only id, label and vector are read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.common import components, cut, table

COSINE = 0.98
TABLES = 4
HASHES = 2
PROBES = 4
BLOCK = 2048
ROWS_PER_TASK = 20000  # many small buckets are compared in one call
SEED = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def probes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, most: int = PROBES) -> np.ndarray:
    """Bucket numbers (rows x tables * most) of unit vectors, of each table the cheapest combinations of axes."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.default_rng(SEED)
    near = min(3, d)
    combos = np.array(list(product(range(near), repeat=hashes)))
    most, out = min(most, len(combos)), []
    for t in range(tables):
        cost, code = np.zeros((n, len(combos))), np.zeros((n, len(combos)), np.int64)
        for k in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            best = np.take_along_axis(y, order, 1)
            axis, loss = 2 * order + (best > 0), np.abs(best[:, :1]) - np.abs(best)
            code = code * (2 * d) + axis[:, combos[:, k]]
            cost += loss[:, combos[:, k]]
        first = np.argsort(cost, axis=1, kind="stable")[:, :most]
        out.append(np.take_along_axis(code, first, 1) * tables + t)
    return np.hstack(out)


def unit(vecs: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vecs])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1))[:, None]


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(c, root, n) of some block pairs: links counted here, and the smallest class linked to c here."""
    pdf = pdf.sort_values(["bucket", "b1", "b2", "c"]).reset_index(drop=True)
    x, keys, m, c, own = unit(pdf.vec), np.stack(pdf["keys"].to_numpy()), pdf.m.to_numpy(np.int64), pdf.c.to_numpy(np.int64), pdf.b.to_numpy()
    bucket, b1, b2 = (pdf[k].to_numpy(np.int64) for k in ("bucket", "b1", "b2"))
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(b1) != 0) | (np.diff(b2) != 0)]))
    count, ends = np.zeros(len(pdf), np.int64), []
    for s, e in zip(starts, [*starts[1:], len(pdf)], strict=True):
        left = right = np.arange(s, e)
        if b1[s] != b2[s]:
            left, right = s + np.flatnonzero(own[s:e] == b1[s]), s + np.flatnonzero(own[s:e] == b2[s])
        for f in range(0, len(left), 512):
            at = left[f : f + 512]
            i, j = np.nonzero(x[at] @ x[right].T >= cosine)
            i, j = at[i], right[j]
            if b1[s] == b2[s]:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            for a in range(0, len(i), 1 << 16):  # is this the first bucket that both are in?
                p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                shared = np.zeros(keys[p].shape, bool)
                for k in range(keys.shape[1]):
                    shared |= keys[p] == keys[q, k][:, None]
                first = np.where(shared, keys[p], np.iinfo(np.int64).max).min(1) == bucket[s]
                np.add.at(count, p[first], m[q[first]])
                np.add.at(count, q[first], m[p[first]])
            ends.append((i, j))
    i, j = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
    root = labels_of(len(pdf), i, j)
    out = pd.DataFrame({"c": c, "root": c[root], "n": count})
    return out[(out.n > 0) | (out.c != out.root)].groupby(["c", "root"], as_index=False).sum()


def near_duplicates(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    fine = F.col(label_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
    # -0.0 and 0.0 are equal numbers
    rows = df.select(F.col(id_col).alias("vec_id"), F.when(fine, F.xxhash64(F.col(label_col), F.transform(v, lambda x: x + 0))).alias("c"), F.when(fine, F.xxhash64(F.col(label_col), F.size(v))).alias("lab"), v.alias("vec"))
    classes = cut(rows.where("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"), F.min("lab").alias("lab"), F.min("vec").alias("vec")))

    @F.pandas_udf("array<long>")
    def buckets(vecs: pd.Series) -> pd.Series:
        out: list = [None] * len(vecs)
        sizes = np.array([len(x) for x in vecs])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for i, row in zip(at, probes(unit(vecs.iloc[at])), strict=True):
                out[i] = row
        return pd.Series(out)

    keyed = classes.select("c", "m", "vec", F.transform(buckets("vec"), lambda k: F.xxhash64(k, F.col("lab"))).alias("keys"))
    keyed = cut(keyed)
    copies = keyed.select("c", "m", "vec", "keys", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = keyed.select(F.explode(F.array_distinct("keys")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    copies = copies.join(sizes, "bucket").withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("c", F.lit(9)), F.col("nb")).cast("int"))
    dealt = copies.select("bucket", "c", "m", "vec", "keys", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("*", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"))

    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("bucket", "b1", "b2"), F.lit(1 + classes.count() * TABLES * PROBES // ROWS_PER_TASK)).cast("int"))
    found = cut(dealt.groupBy("task").applyInPandas(lambda pdf: compare(pdf, cosine), "c long, root long, n long"))
    groups = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    groups = groups.join(classes.select(F.col("c").alias("node"), "rep"), "node")
    least = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
    degree = found.groupBy("c").agg(F.sum("n").alias("n"))
    info = classes.select("c", "m", "rep").join(degree, "c", "left").join(groups.select(F.col("node").alias("c"), "root"), "c", "left").join(least, "root", "left")
    info = info.select("c", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "c").join(info, "c", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))


def op9_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
