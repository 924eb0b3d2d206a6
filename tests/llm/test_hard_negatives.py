"""Hard negatives against brute force, the cover tree's bounds, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mwspark.llm.hard_negatives import CoverTree, mine

SCHEMA = "vec_id long, embedding array<float>, label int, score int, row int, block int, own int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def make(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], k, 1, 1, 1, 1) for i, v, k in rows], SCHEMA)


def brute(rows, every, k=5, scale=256):
    fine = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], k) for i, v, k in rows if None not in (i, v, k) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (aid, av, ak) in enumerate(fine):
        if aid % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, c == ak) for j, (i, v, c) in enumerate(fine) if j != a)  # noqa: B905
        for ps, pid, _ in [x for x in scored if x[2]][:k]:
            inside = [(ns, nid) for ns, nid, same in scored if not same and 80 * -ps <= 100 * -ns <= 100 * -ps]
            out += [(aid, pid, r, nid, -ps, -ns) for r, (ns, nid) in enumerate(inside[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(int(x) for x in r) for r in df.toPandas()[COLUMNS].itertuples(index=False))


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.2
    v[:150] = centres[0] + rng.normal(size=(150, 8)) * 0.02  # a hot cluster
    v[150:160] = v[150]  # ties
    v *= rng.uniform(0.5, 2, 400)[:, None]
    v[150:160] = v[150]
    labels = rng.integers(0, 6, 400)
    labels[:200:2] = 3  # a hot label
    return [(i, v[i].astype(np.float32).tolist(), int(labels[i])) for i in range(400)]


@pytest.mark.parametrize(("block", "anchors", "leaf"), [(8192, 32768, 128), (60, 32768, 4), (25, 1, 1)])
def test_against_brute_force(spark, cloud, block, anchors, leaf):
    got = mine(make(spark, cloud), F.col("vec_id") % 20 == 0, block=block, anchors=anchors, leaf=leaf)
    assert rows_of(got) == brute(cloud, 20) and len(brute(cloud, 20)) > 200


def test_bounds_hold_for_every_node(cloud):
    points = np.floor(256 * np.array([v for _, v, _ in cloud]))
    tree = CoverTree(points, leaf=4)
    low, high = tree.bounds(points[:50])
    below = [list(o) for o in tree.own]
    for node in range(len(below) - 1, -1, -1):
        for child in tree.children[node]:
            below[node] += below[child]
    assert sorted(below[0]) == list(range(400)) and len(below) > 20
    for node, at in enumerate(below):
        s = points[:50] @ points[at].T
        assert (s >= low[:, node, None]).all() and (s <= high[:, node, None]).all()


def test_odd_rows(spark):
    bad = [(0, None, 1), (0, [1, None], 1), (0, [1, float("nan")], 1), (0, [float("inf"), 1], 1), (0, [1, 1], None), (None, [1, 1], 1)]
    good = [(0, [1, 1], 1), (0, [1, 1], 1), (3, [1], 1), (4, [1, 1], 1), (5, [0.9, 1], 2), (5, [0.9, 1], 2), (6, [-1, -1], 2), (7, [], 2), (8, [0, 0], 1)]
    want = brute([(i, [*v, 0, 0][:2], k) for i, v, k in good], 20)
    assert rows_of(mine(make(spark, bad + good), F.col("vec_id") % 20 == 0)) == want and want
    assert mine(make(spark, bad), F.col("vec_id") % 20 == 0).count() == 0
    assert mine(make(spark, good).where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert mine(make(spark, good[:1]), F.col("vec_id") % 20 == 0).count() == 0
