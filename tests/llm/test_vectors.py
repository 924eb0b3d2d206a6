"""Vector operators against brute force, and on null, zero and non-finite vectors, ties, repeated rows and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mwspark.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score int, c int, norm int"


def make(spark, vectors, labels=None, ids=None):
    labels = [0] * len(vectors) if labels is None else labels
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, 1, 1) for i, v, k in zip(ids, vectors, labels, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    near = base[:20].repeat(6, 0) + rng.normal(size=(120, 16)) * 0.05
    hot = base[59] + rng.normal(size=(150, 16)) * 0.03
    return np.vstack([base, near, hot, hot[:5]]).astype(np.float32)


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates(spark, vectors, block):
    labels = [i % 2 if i < 60 else 0 for i in range(len(vectors))]
    got = embed_dedup.near_duplicates(make(spark, vectors.tolist(), labels), block=block).toPandas().sort_values("vec_id")
    v = vectors.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(link, False)
    assert got.n_links.sum() >= 0.97 * link.sum() and (got.n_links.to_numpy() <= link.sum(1)).all()
    root = embed_dedup.labels_of(len(v), *np.nonzero(link))
    assert (got.component_id.to_numpy() == root).mean() > 0.99
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_near_duplicate_edge_cases(spark):
    odd = [None, [], [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 0], [2, 0], [1e-30, 0], [1, 0, 0], [1, 0]]
    df = make(spark, odd, [0] * 10 + [None])
    got = embed_dedup.near_duplicates(df).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == [0] * 6 + [2, 2, 2] + [0, 0]
    assert got.component_id.tolist() == [0, 1, 2, 3, 4, 5, 6, 6, 6, 9, 10]
    twice = embed_dedup.near_duplicates(df.where("vec_id = 6").union(df.where("vec_id = 6"))).toPandas()
    assert twice.n_links.tolist() == [1, 1]
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize(("block", "coord"), [(4096, 0.6), (16, -2.0), (16, 2.0)])
def test_top_k(spark, vectors, block, coord):
    v = vectors * np.linspace(0.2, 5, len(vectors))[:, None].astype(np.float32)
    got = topk.top_k(make(spark, v.tolist()), F.col("vec_id") % 7 == 0, k=9, block=block, coord_from=coord).toPandas()
    whole = np.floor(64 * v.astype(float)).astype(np.int64)
    score = whole @ whole.T
    for q in range(0, len(v), 7):
        order = sorted((i for i in range(len(v)) if i != q), key=lambda i: (-score[q, i], i))[:9]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == order and own.score.tolist() == [score[q, i] for i in order] and own["rank"].tolist() == list(range(1, 10))


def test_top_k_edge_cases(spark):
    odd = [[1, 1], None, [None, 1], [float("nan"), 1], [float("inf"), 0], [0, 0], [-1, 1], [1], [1e30, 1e30], [1, 1]]
    got = topk.top_k(make(spark, odd), F.col("vec_id") == 0).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [8, 9, 7, 5, 6] and got["rank"].tolist() == [1, 2, 3, 4, 5]
    assert got.score.tolist()[1:] == [8192, 4096, 0, 0] and got.score.iloc[0] == 2**63 - 1
    assert topk.top_k(make(spark, odd).where("false"), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(make(spark, odd[:1]), F.col("vec_id") == 0).count() == 0


def test_top_k_takes_rows_of_one_id_as_rows(spark):
    df = make(spark, [[1, 0], [1, 0], [2, 0], [3, 0], [3, 0]], ids=[0, 1, 1, 0, None])
    got = topk.top_k(df, F.col("vec_id") == 0, k=5).toPandas()
    rows = [(0, 64), (1, 64), (1, 128), (0, 192)]
    want = []
    for i, (q, x) in enumerate(rows):
        if q == 0:  # each row of the query's id asks for itself; all other rows answer
            best = sorted(((-x * y, c) for j, (c, y) in enumerate(rows) if j != i))
            want += [(rank, c, -score) for rank, (score, c) in enumerate(best, 1)]
    assert sorted(zip(got["rank"], got.vec_id, got.score, strict=True)) == sorted(want)
