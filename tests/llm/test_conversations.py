"""The prefix trie against a plain one, over several shards and tiers, with hot and odd conversations."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mwspark.llm import conversation_trie
from mwspark.llm.conversation_trie import TernaryTree, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, part int, size int, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x") for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[p]]
        sums[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[p]) - 1) * len(p[-1][1] if p else ""))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(full[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def talk():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(-5, 420):
        if c == 200:  # a base that isn't there
            continue
        n = int(rng.integers(1, 9))
        words = rng.integers(0, 2, n) if c % 3 else np.zeros(n, int)  # a third share all their turns
        rows += [(c, None if rng.random() < 0.05 and i == 0 else i, ("user", "assistant", None)[i % 3], None if w == 0 and i == 4 else f"t{w}é" * (i + 1)) for i, w in enumerate(words)]
    for c in (900, 901, 902):  # long ones: two alike
        rows += [(c, i, "user", f"{i if c < 902 or i < 40 else -i}") for i in range(70)]
    return rows


@pytest.mark.parametrize(("depth", "shard"), [(1024, 10**6), (1024, 40), (8, 100), (3, 10**6)])
def test_against_brute_force(spark, talk, depth, shard):
    assert rows_of(prefix_trie(make(spark, talk), depth, shard)) == brute(talk)


def test_copies_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS", 3)
    rows = [(c, i, "user", "same") for c in range(1, 99) for i in range(7)] + [(c, i, "user", f"x{c}") for c in range(101, 140) for i in range(3)]
    assert rows_of(prefix_trie(make(spark, rows), 1024, 20)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (7, None, None, None), (7, None, None, None), (7, 1, "user", ""), (7, 1, "user", ""), (12, 5, "user", "b"), (105, 0, "a", "bc"), (106, 0, "ab", "c"), (3, 2, None, "z" * 100_000), (-250, 1, "x", "y")]
    assert rows_of(prefix_trie(make(spark, rows))) == brute(rows)
    assert prefix_trie(make(spark, rows).where("false")).count() == 0 and prefix_trie(make(spark, rows[:1])).count() == 0


def test_ternary_tree():
    rng = np.random.default_rng(1)
    sequences = sorted({tuple(rng.integers(0, 9, rng.integers(0, 6)).tolist()) for _ in range(300)})
    tree = TernaryTree()
    nodes = tree.insert_sorted([list(s) for s in sequences])

    def spelled(node):
        out = []
        while node:
            out.append(tree.symbol[node])
            node = tree.parent[node]
        return tuple(out[::-1])

    assert [spelled(x) for x in nodes] == sequences
    listed = [spelled(x) for x in tree.preorder()]
    assert listed == sorted({s[:d] for s in sequences for d in range(len(s) + 1)} | {()})
