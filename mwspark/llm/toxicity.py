"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, of toxic and of ordinary texts, share one unigram distribution to back off to: the
Kneser-Ney continuation counts of both classes together. Counts are of texts that hold a word or bigram; those of a class are used only for words and
bigrams that are seen MIN_COUNT times in all; rarer expressions are left to the shared counts. The log-likelihood
ratio of each word is averaged over the whole text and over its most toxic passages (length-normalised), and a
logistic curve, fitted on labelled texts that the models have not seen, turns these into a probability at the
classes' shares among the labels.

Fitted on at most TOXIC labelled toxic texts and ORDINARY_PER_TOXIC times as many ordinary ones, picked by a hash
of their id; equal texts and families of near copies of one label count once in the sample. A third of them, by a hash of the text, is kept for the curve. The n-gram counts are
made by Spark; only those that MIN_COUNT keeps come to the driver, bounded by the sample, and are broadcast.

Scores read the text alone: whole texts of any length, a null text as an empty one, which like any text
without words gets the share of toxic labels. Without labels of both classes every score is that share
(0 without labels). Null labels and labels of unknown rows are not used; a doc_id with several labels is toxic if
one of them is. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.common import bounded_batches, cut, fold, release_memory, table
from mwspark.llm.jaccard import shingles
from mwspark.llm.words import PUNCTUATION, batches, mix, words_of

TOXIC = 4000
ORDINARY_PER_TOXIC = 3
MIN_COUNT = 8
DISCOUNT = 0.75
SHARED = 0.008  # counts that both classes hold alike of each word, as a share of the toxic texts; LEAST_SHARED at least
LEAST_SHARED = 5.0
SHARED_CONTEXT = 200.0
PASSAGES = (1, 6, 24)
FEATURES = 2 + 2 * len(PASSAGES)  # the mean over the text; the best passage's mean and its square; the logarithm of the length
COPIES = 3  # least hashes by which near copies in the sample are found
NEAR = 0.2  # of the union of their shingles that texts of one family share: a family is either the models' or the curve's
ALONE = np.uint64(0x5851F42D4C957F2D)  # the context that stands for none in particular
THRESHOLD = 0.3


def _u(x: pd.Series) -> np.ndarray:
    return x.to_numpy(np.int64).view(np.uint64)


class Table:
    """Numbers by 64-bit key: sorted keys and rows of values; unknown keys give the last row."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, unknown: list[float]) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.vstack([values[order].reshape(len(keys), len(unknown)), [unknown]]).astype(np.float64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.values[np.zeros(len(keys), np.int64)]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[np.where(self.keys[at] == keys, at, len(self.keys))]


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019))


def words_and_contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, bounds = words_of(texts, PUNCTUATION)
    v = np.concatenate([np.zeros(1, np.uint64), w[:-1]]) if len(w) else w.copy()
    starts = bounds[:-1]
    v[starts[starts < len(w)]] = 0
    return w, v, bounds


class Model:
    """Class 1 is toxic. weights: the logistic curve over the features."""

    def __init__(self, uni: pd.DataFrame, ctx: pd.DataFrame, bi: pd.DataFrame, totals: dict) -> None:
        d = DISCOUNT
        size = np.array([max(1, totals["c0"]), max(1, totals["c1"])], float)
        share, n, vocab = size / size.sum(), max(1, totals["types"]), max(1, totals["words"])
        cont = np.append(uni["cont"].to_numpy(float), 0)  # last: a word that is rare or new
        shared = (np.maximum(cont - d, 0) + d) / (n + d * vocab)
        c = np.vstack([uni[["c0", "c1"]].to_numpy(float), [0, 0]])
        # each word has SHARED counts that both classes hold alike; beyond them stands the shared distribution
        p = (np.maximum(c - d, 0) + max(LEAST_SHARED, SHARED * totals["toxic"]) * share + d * vocab * share * shared[:, None]) / size
        p[-1] = d * vocab * share * shared[-1] / size
        self.uni = Table(_u(uni["w"]), p[:-1], list(p[-1]))
        c, kinds = ctx[["c0", "c1"]].to_numpy(float), ctx[["n0", "n1"]].to_numpy(float)
        self.ctx = Table(_u(ctx["v"]), np.hstack([(d * kinds + SHARED_CONTEXT) / (c + SHARED_CONTEXT), c + SHARED_CONTEXT]), [1.0, 1.0, 1.0, 1.0])
        self.bi = Table(bigram_key(_u(bi["v"]), _u(bi["w"])), np.maximum(bi[["c0", "c1"]].to_numpy(float) - d, 0), [0.0, 0.0])
        self.weights: np.ndarray | None = None
        self.base = 0.0

    def ratios(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """log P_toxic(w | v) - log P_ordinary(w | v) of each word."""
        words, where = np.unique(w, return_inverse=True)
        ctx = self.ctx(v)
        p = self.bi(bigram_key(v, w)) / ctx[:, 2:] + ctx[:, :2] * self.uni(words)[where]
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for a, b in batches(texts, 2 << 20):
            w, v, bounds = words_and_contexts(texts[a:b])
            total = np.concatenate([[0.0], np.cumsum(self.ratios(w, v))]) if len(w) else np.zeros(1)
            for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if y > x:
                    out[a + i, 0] = (total[y] - total[x]) / (y - x)
                    out[a + i, -1] = np.log(y - x)
                    for k, size in enumerate(PASSAGES):
                        size = min(size, y - x)
                        best = ((total[x + size : y + 1] - total[x : y + 1 - size]) / size).max()
                        out[a + i, 1 + 2 * k : 3 + 2 * k] = best, best * abs(best)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        x = self.features(texts)
        return np.where(np.array([bool(t.strip()) for t in texts]), 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30))), self.base)


def curve(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept is moved to the given share of class 1."""
    x1 = np.column_stack([np.ones(len(x)), x])
    scale = np.maximum(np.abs(x1).max(0), 1e-9)
    z, beta = x1 / scale, np.zeros(x1.shape[1])
    ridge = np.full(len(beta), 0.05)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    beta /= scale
    mean = min(max(y.mean(), 1e-6), 1 - 1e-6)
    beta[0] += np.log(share / (1 - share)) - np.log(mean / (1 - mean))
    return beta


def count_ngrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class that hold a bigram (v, w), or with v ALONE the word w: once for each text, so that one that repeats itself weighs no more."""
    for pdf in frames:
        texts = [(t or "").encode() for t in pdf.text]
        for a, b in batches(texts):
            w, v, bounds = words_and_contexts(texts[a:b])
            doc = np.repeat(np.arange(a, b), np.diff(bounds))
            alone = np.full(len(w), ALONE)
            each = pd.DataFrame({"doc": np.tile(doc, 2), "v": np.concatenate([v, alone]).view(np.int64), "w": np.tile(w, 2).view(np.int64)}).drop_duplicates()
            each["c1"] = pdf.toxic.to_numpy(np.int64)[each.doc]
            each["c0"] = 1 - each.c1
            yield each.drop(columns="doc").groupby(["v", "w"], as_index=False)[["c0", "c1"]].sum()


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", toxic: int = TOXIC) -> Model:
    """Fits the models and the curve on labelled rows where usable (a Column over doc_id) holds."""
    named = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = dict(named.groupBy("toxic").count().collect())
    most = {1: toxic, 0: ORDINARY_PER_TOXIC * max(1, min(toxic, n.get(1, 0)))}
    slot = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20))
    picked = [(F.col("toxic") == k) & (slot < int(min(1, most[k] / n[k]) * (1 << 20))) for k in n]
    # bounded by the sample's size, so the ids can be broadcast
    ids = F.broadcast(named.where(picked[0] | picked[-1])) if n else named
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id").where("text IS NOT NULL")
    rows = one_of_each(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    rows = cut(rows.withColumn("kept", F.pmod("h", F.lit(3)) == 0))
    ngrams = cut(rows.where("not kept").select("text", "toxic").mapInPandas(count_ngrams, "v long, w long, c0 long, c1 long").groupBy("v", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    alone = F.col("v") == int(ALONE.view(np.int64))
    bigrams = ngrams.where(~alone)
    uni = cut(ngrams.groupBy("w").agg(F.sum(F.when(alone, F.col("c0"))).alias("c0"), F.sum(F.when(alone, F.col("c1"))).alias("c1"), F.count(F.when(~alone, 1)).alias("cont")))
    ctx = bigrams.groupBy("v").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count(F.when(F.col("c0") > 0, 1)).alias("n0"), F.count(F.when(F.col("c1") > 0, 1)).alias("n1"))
    often = F.col("c0") + F.col("c1") >= MIN_COUNT
    totals = uni.agg(*[F.coalesce(x, F.lit(0)).alias(k) for k, x in {
        "c0": F.sum("c0"), "c1": F.sum("c1"), "t0": F.count(F.when(F.col("c0") > 0, 1)), "t1": F.count(F.when(F.col("c1") > 0, 1)), "words": F.count("*"), "types": F.sum("cont")}.items()]).first().asDict()
    totals["toxic"] = rows.where("not kept AND toxic = 1").count()
    model = Model(uni.where(often).toPandas(), ctx.where(often).toPandas(), bigrams.where(often).toPandas(), totals)
    share = n.get(1, 0) / max(1, sum(n.values()))
    model.base = share
    if totals["c0"] and totals["c1"]:
        x = feature_rows(rows.where("kept"), model)
        if len(x) and 0 < x["toxic"].mean() < 1:
            names = [f"f{i}" for i in range(FEATURES)]
            model.weights = curve(x[names].to_numpy(float), x["toxic"].to_numpy(float), share)
    release_memory()
    return model


def one_of_each(rows: DataFrame) -> DataFrame:
    """One text of each family of one label: texts that share a least shingle hash, of one kind after another, and whose
    shingles overlap in NEAR of their union. Texts of different labels are never merged; rows are a bounded sample."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = list(shingles([t.encode() for t in pdf.text]))
            least = {f"m{i}": [int(mix(s ^ np.uint64(i * 0x9E3779B97F4A7C1 + 1)).min().view(np.int64)) if len(s) else i for s in sets] for i in range(COPIES)}
            yield pdf.assign(**least)

    def first_of_copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "text"])
        kept: list[int] = []
        seen: list[np.ndarray] = []
        for i, s in enumerate(shingles([t.encode() for t in pdf.text])):
            if not any(near_copies(s, x) for x in seen):
                kept.append(i)
                seen.append(s)
        return pdf.iloc[kept]

    names = [f"m{i}" for i in range(COPIES)]
    schema = "h long, text string, toxic int, " + ", ".join(f"{m} long" for m in names)
    rows = cut(rows.mapInPandas(run, schema))
    for m in names:
        rows = rows.groupBy(m, "toxic").applyInPandas(first_of_copies, schema)
    return rows.select("h", "text", "toxic")


def near_copies(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles share NEAR of their union."""
    if min(len(a), len(b)) < NEAR * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= NEAR * (len(a) + len(b) - common)


def feature_rows(rows: DataFrame, model: Model) -> pd.DataFrame:
    """Features and labels of the rows that are kept for the curve: a few numbers for each of a bounded sample."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"f{i}" for i in range(FEATURES)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pd.DataFrame(shared.value.features([(t or "").encode() for t in pdf.text]), columns=names)
            yield out.assign(toxic=pdf.toxic.to_numpy(np.int64))

    return rows.select("text", "toxic").mapInPandas(run, ", ".join(f"{n} double" for n in names) + ", toxic long").toPandas().sort_values([*names, "toxic"])


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability that a text is toxic; the model is a broadcast variable."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([(t or "").encode() for t in s]))

    return udf(text)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
