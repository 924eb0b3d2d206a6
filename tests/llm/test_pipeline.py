"""The pipeline's stages on a small fixture: what goes, what stays, and in which columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

WORDS = [f"{a}{b}" for a in "ba de fi go lu ma".split() for b in "ra to ni ke su mo la".split()]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(WORDS, k=80)) + (" vilex gruntz snarkle" if i % 5 == 0 else ""), "en", f"s{i % 4}", 1) for i in range(400)]
    docs += [(1000, docs[1][1], "en", "s1", 1), (1001, docs[2][1] + " tail", "en", "s1", 1), (1002, docs[3][1] + ' token = "abcdef0123456789abcdef0123456789"', "en", "s2", 1), (1003, "12345 !!", "en", "s", 1), (1004, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, step = docs.columns, dict(C.STAGES)
    clean = C.cut(step["toxicity"](spark, docs, sf_dir))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} >= {i for i in range(400) if i % 5} | {1000, 1001, 1002}
    assert clean.where("doc_id % 5 = 0 AND doc_id < 400").isEmpty()
    known = C.cut(step["language ID"](spark, clean, sf_dir))
    assert known.columns == columns and known.where("doc_id IN (1003, 1004)").isEmpty() and clean.count() - known.count() <= 2
    single = C.cut(step["n-gram Jaccard join"](spark, known, sf_dir))
    assert single.columns == columns and {r.doc_id for r in known.join(single, "doc_id", "left_anti").collect()} == {1000, 1001, 1002}
    masked = step["secret scans"](spark, known, sf_dir)
    assert masked.columns == columns and masked.count() == known.count()
    r = masked.where("doc_id = 1002").first()
    assert "abcdef0123456789" not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text)
    assert masked.where("doc_id = 1").first().n_chars == 1
    packed = step["packing"](spark, masked, sf_dir)
    assert packed.select("doc_id").distinct().count() == masked.count()


def test_empty_table_runs_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = C.cut(stage(spark, docs, sf_dir))
        assert docs.count() == 0


def test_stages_take_clashing_names_and_repeated_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id >= 1000 OR doc_id < 20")
    for name in ("found", "new_text", "row", "text_key", "dup", "score", "p"):
        docs = docs.withColumn(name, docs.doc_id * 2)
    docs = docs.union(docs.where("doc_id = 1002")).union(docs.where("doc_id = 1002").withColumn("text", F.concat("text", F.lit("\n" + "word " * 50_000))))
    masked = C.cut(dict(C.STAGES)["secret scans"](spark, docs, sf_dir))
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.where("found <> doc_id * 2 OR new_text <> doc_id * 2").isEmpty() and masked.where("doc_id = 1002 AND text LIKE '%[SECRET]%'").count() == 3
    single = dict(C.STAGES)["n-gram Jaccard join"](spark, docs, sf_dir)
    assert single.columns == docs.columns
