"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (2^BITS buckets x languages) that is fitted on at most
SAMPLE_PER_LANG documents of each language, picked by a hash of their id among the rows that may be learned from, and
broadcast. n-grams of 1 to 3 characters of the lower-cased text with white space and digits folded are
hashed; a batch of texts is scored sparsely, one gather of matrix rows per n-gram and a sum per text.

Predictions read the text alone. lang_pred is `und` with score 0 if the text is null, empty or without
letters, or if there is nothing to learn from. score is the posterior at CALM n-grams' worth of evidence.
Ties go to the language first in order. Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.common import bounded_batches, fold, table

BITS = 16
SAMPLE_PER_LANG = 3000
CALM = 40
CHARS = 1 << 19  # scored at once


def _folded() -> np.ndarray:
    """Lower-case code point of each code point; white space 32, digits and what isn't a letter 48; the letter flag is bit 31."""
    out = np.full(0x110000, 48, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = (ord(low) if len(low) == 1 else i) | 1 << 31
        elif c.isspace():
            out[i] = 32
    return out


_TABLE: list[np.ndarray] = []


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each followed by two spaces, and the bounds of the texts."""
    if not _TABLE:
        _TABLE.append(_folded())
    raw = np.frombuffer("  ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=bounds[1:])
    return _TABLE[0][raw], bounds


def grams(cp: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that end at each code point; before a text stand spaces."""
    x = cp.astype(np.uint64) & np.uint64(0x7FFFFFFF)
    h, shift = np.zeros(len(x), np.uint64), np.uint64(64 - bits)
    for n in range(3):
        h = h * np.uint64(0x100000001B3) + (x if not n else np.concatenate([np.full(n, 32, np.uint64), x[:-n]])) + np.uint64(n + 1)
        yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARS:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.weights, self.prior = langs, weights, prior
        self.bits = int(np.log2(len(weights))) if len(weights) else BITS

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a, b in slices(texts):
            cp, bounds = points(texts[a:b])
            letters = np.add.reduceat(cp >> 31, bounds[:-1], dtype=np.int64)
            if not self.langs:
                names += ["und"] * (b - a)
                scores += [0.0] * (b - a)
                continue
            total = np.zeros((b - a, len(self.langs)))
            for bucket in grams(cp, self.bits):
                total += np.add.reduceat(self.weights[bucket], bounds[:-1], axis=0, dtype=np.float64)
            n = 3.0 * np.diff(bounds)
            z = total * np.minimum(1, CALM / n)[:, None] + self.prior
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = (total + self.prior).argmax(1)
            for i, k in enumerate(best):
                names.append(self.langs[k] if letters[i] else "und")
                scores.append(float(p[i, k]) if letters[i] else 0.0)
        return names, scores


def fit(rows: DataFrame, bits: int = BITS, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on a bounded sample of rows with a text and a language."""
    d = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counts = {r[0]: r[1] for r in d.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0))
    langs = sorted(counts)
    keep = F.lit(False)
    for lang in langs:  # a share of each language, by the hash of the id
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(min(1, per_lang / counts[lang]) * (1 << 20))))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in frames:
            for lang, own in pdf.groupby("lang"):
                sums = held.setdefault(lang, np.zeros(1 << bits, np.int64))
                texts = list(own.text)
                for a, b in slices(texts):
                    for bucket in grams(points(texts[a:b])[0], bits):
                        sums += np.bincount(bucket, minlength=1 << bits)
        for lang, sums in held.items():
            yield pd.DataFrame({"lang": [lang], "sums": [sums.astype("<i8").tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "sums": [sum(np.frombuffer(x, "<i8") for x in pdf.sums).tobytes()]})

    tasks = max(1, min(16, len(langs) * per_lang // 500))  # the sample is bounded, and so are the partial counts
    sample = d.where(keep).repartition(tasks, F.xxhash64("doc_id", "text"))
    got = {r[0]: np.frombuffer(r[1], "<i8") for r in sample.mapInPandas(count, "lang string, sums binary").groupBy("lang").applyInPandas(add, "lang string, sums binary").collect()}
    langs = sorted(got)
    c = np.stack([got[x] for x in langs], 1) + 0.5 if langs else np.zeros((0, 0))
    seen = np.array([counts[x] for x in langs], float)
    return Model(langs, np.log(c / c.sum(0)).astype(np.float32) if langs else c.astype(np.float32), np.log(seen / seen.sum()) if langs else seen)


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column; the matrix is a broadcast variable."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def udf(s: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.score([t or "" for t in s])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return udf(text)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0


def op3_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
