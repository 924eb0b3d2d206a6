"""A cleaning pipeline over documents: toxicity, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame;
between stages the rows are written as Parquet and read again. All but the last return the columns of docs.

toxicity: the models of op8 are fitted on the rows of docs that `labels` covers; rows with a score of 0.3 or more go.
language ID: the model of op3 is fitted on the languages that docs names; rows without letters or whose best
language gets less than half of the evidence go.
n-gram Jaccard join: the groups of op6; the row with the smallest doc_id of each group stays. Rows without words
are in no group and stay. Rows of one doc_id are one document: they stay or go together.
secret scans: all spans of op1 are replaced by a mark in the text, and n_chars follows; no row goes.
packing: op2's pieces, one row each.

An empty table passes through every stage; null texts count as empty ones and go at language ID.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm import jaccard, langid, packing, secrets, toxicity
from mwspark.llm.common import cut, release_memory, table

SURE = 0.5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = docs.select(F.struct(*docs.columns).alias("row"), toxicity.score(spark, model, F.col("text")).alias("score"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_memory()
    model = langid.fit(docs)
    scored = docs.select(F.struct(*docs.columns).alias("row"), langid.predict(spark, model, F.col("text")).alias("p"))
    return scored.where((F.col("p.lang_pred") != "und") & (F.col("p.score") >= SURE)).select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_memory()
    found = jaccard.join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("dup")).distinct()
    return docs.join(found, docs.doc_id == found.dup, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_memory()
    found = secrets.scan(docs)
    spans = found.select("text_key", F.concat("base", "owned").alias("found")).where(F.size("found") > 0)
    spans = cut(spans.groupBy("text_key").agg(F.first("found").alias("found")))  # spans follow from the text
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(11))
    with_spans = docs.select(F.struct(*docs.columns).alias("row"), key.alias("text_key")).join(spans, "text_key", "left")
    text = F.when(F.col("found").isNotNull(), secrets.redacted(F.col("row.text"), F.col("found"))).otherwise(F.col("row.text"))
    # the columns of docs stay inside row, so they may have any name
    out = with_spans.select("row", "found", text.alias("new_text"))
    n_chars = F.when(F.col("found").isNotNull(), F.length("new_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[F.col("new_text").alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_memory()
    return packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: SQL expresses neither the trained stages nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
