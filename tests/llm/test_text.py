"""Text operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mwspark.llm import bpe, jaccard, langid, packing, secrets, sharding, toxicity
from mwspark.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lorem ipsum dolor sit amet tempor magna aliqua erat sed".split()


def make(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, white space, one long text, repeats, a repeated and a null id, clashing column names."""
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    texts = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h", long, "É ß 中文 🙂 x" * 3, "a b c d e f g h"]
    df = make(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, None])
    df = df.union(df.where("doc_id = 4"))
    for name in ("score", "shard", "slot", "cls", "n", "keys", "h", "g", "base", "spans", "ids", "count", "row"):
        df = df.withColumn(name, F.lit(1))
    return df


def test_secrets_match_brute_force(spark):
    rng = random.Random(3)
    parts = ['token = "abcdefgh1', "PassWord:'x", "secret=", "AKIA1234567890AB", "AKIAAKIA", "0123456789abcdef" * 2, " api_key : zzzzzzzzz", "token=token=abcdefgh", "é🙂", "ſecret=abcdefgh", '"', "'", "\n", "token: 'secret: abcdefghij"]
    docs = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "x" * 50_000 + "token=abcdefghi"]
    assign = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in secrets.scan(make(spark, docs)).withColumn("j", secrets.joined(F.col("base"))).collect()}
    for i, t in enumerate(docs):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].j == want, t


def test_ownership_separates_examples_from_own_tokens(spark):
    shared, own = "EXAMPLEtoken1234567890abcd", "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    df = make(spark, [f"see {shared}", f"use {shared} here", f"or {shared}", f"mine {own}", None])
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [got[i].n_example for i in range(4)] == [1, 1, 1, 0]
    assert not got[0].owned and [s.value for s in got[3].owned] == [own]
    text = df.join(secrets.scan(df).select("doc_id", "base", "owned"), "doc_id").select("doc_id", secrets.redacted(F.col("text"), F.concat("base", "owned")).alias("t"))
    assert {r.doc_id: r.t for r in text.collect()}[3] == "mine [SECRET]"


def test_redaction_of_overlapping_and_many_spans(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(30):
        text = "".join(rng.choice(list("abé\U0001f600\n"), int(rng.integers(1, 5000))))
        starts = rng.integers(0, len(text), int(rng.integers(0, 40)))
        rows.append((i, text, [(int(a), 0, int(min(len(text), a + rng.integers(1, 90))), "") for a in starts]))
    text = " ".join(f"token=abcdefgh{i}" for i in range(24_000))
    rows.append((30, text, [(m.start(), 0, m.end(), "") for m in re.finditer(r"token=\w+", text)]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, found {secrets.SPAN}")
    began = time.time()
    got = {r.doc_id: r.t for r in df.select("doc_id", secrets.redacted(F.col("text"), F.col("found"), "#").alias("t")).collect()}
    assert time.time() - began < 20
    for i, text, found in rows:
        out, at = "", 0
        for a, _, b, _ in sorted(found):
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, b)
        assert got[i] == out + text[at:]


def test_ownership_reads_repositories_and_counts_exact_copies_once(spark):
    example, live, few = "EXAMPLEtoken1234567890abcd", "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "fewTEXTSoken1234567890abcd"
    rows = [(k, f"text {k} {example}", "one") for k in range(secrets.MAX_REPOS + 1)] + [(100 + k, f"mine {live}", f"s{k}") for k in range(secrets.MAX_OWNERS + 2)]
    rows += [(200 + k, f"text {k} {few}", "one") for k in range(secrets.MAX_REPOS)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        n = secrets.MAX_REPOS + 1 if i < 100 else 1 if i < 200 else secrets.MAX_REPOS
        assert (got[i].n_example, [s.value for s in got[i].owned], got[i].n_repos) == ((1, [], n) if i < 100 else (0, [text.split()[-1]], n))


def test_only_live_looking_tokens_are_owned(spark):
    texts = ["key ExampleKey0a1b2c3d4e5f6g", "key ababababababababab12", "key q8W3e7R1t6Y2u5I9o0P4"]
    got = {r.doc_id: r for r in secrets.scan(make(spark, texts)).collect()}
    assert [len(got[i].owned) for i in range(3)] == [0, 0, 1] and [got[i].n_example for i in range(3)] == [1, 1, 0]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abcdefgh{i}" for i in range(20_000))
    began = time.time()
    got = secrets.scan(make(spark, [text])).first()
    assert [(s.start, s.end) for s in sorted(got.base)] == [m.span() for m in re.finditer(r"token=\w+", text)]
    assert time.time() - began < 30


@pytest.fixture(scope="module")
def oracle():
    return Tokenizer.from_file(packing.VOCABULARY)


def test_both_engines_give_the_same_ids(oracle):
    """Each token alone merges to itself by the file's own merges; then merging by rank and by merge list agree."""
    import json

    value = packing.byte_values()
    with open(packing.VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    own = {}
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        own.setdefault(vocab[a], {})[vocab[b]] = vocab[a + b]
    codec = bpe.Codec(bpe.RANKS)
    whole = {bytes(value[c] for c in t): i for t, i in vocab.items() if t not in special}
    assert whole == codec.ranks
    last = codec.last  # inside, a token's number is last - id
    codec.ranks, codec.right = {}, [{last - y: last - z for y, z in own.get(last - i, {}).items()} for i in range(last + 1)]
    assert all(codec.merge(token) == [i] for token, i in whole.items())
    rng = random.Random(5)
    texts = ["".join(rng.choices(" \n\tab'sé中🙂1_-.<|endoftext|>", k=rng.randint(0, 60))) for _ in range(2000)]
    want = oracle.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(packing.ids_of(t, packing.VOCABULARY), "<u4").tolist() == w.ids for t, w in zip(texts, want, strict=True))


@pytest.mark.parametrize("run", [" " * 1_000_000, " " * 10_000_000, "\n \u3000\t" * 30_000, " " * (packing.LONG_RUN - 1), " " * packing.LONG_RUN])
def test_very_long_white_space(oracle, run):
    few = len(run) > 2_000_000
    for text in (run, f"a{run}b") if few else (run, f"a{run}b", f"{run}9{run}<|endoftext|>{run}'s x{run[:7]}"):
        got = np.frombuffer(packing.ids_of(text, packing.VOCABULARY), "<u4")
        assert np.array_equal(got, np.array(oracle.encode(text, add_special_tokens=False).ids, np.uint32))


def test_added_tokens_in_a_text_are_matched(spark):
    default = Tokenizer.from_file(packing.VOCABULARY)
    rng = random.Random(6)
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choices(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a", "é", "'s", "1", "<|ENDOFTEXT|>"], k=rng.randint(0, 20))) for _ in range(1000))]
    for t in texts:
        assert np.frombuffer(packing.ids_of(t, packing.VOCABULARY), "<u4").tolist() == default.encode(t, add_special_tokens=False).ids, repr(t)
    got = packing.pack(make(spark, texts[:1])).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == [64, 220, 50256, 275, packing.END] and got.doc_tokens == 5


def test_bpe_equals_tiktoken_and_decodes_back(spark, odd):
    codec = bpe.Codec(bpe.RANKS)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choices(" \n\t\x0b\x1c\xa0ab'stre1é中🙂_-.", k=rng.randint(0, 40))) for _ in range(3000)] + ["a" * 20_000, "".join(rng.choices("etaoin", k=20_000))]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()
    rows = odd.select("text", bpe.encode(F.col("text")).alias("i")).withColumn("d", bpe.decode(F.col("i"))).collect()
    assert len(rows) == 10 and all(bytes(r.d) == (r.text or "").encode() for r in rows)
    assert odd.where("false").select(bpe.encode(F.col("text"))).collect() == []


def test_packing_is_gapless_and_complete(spark, oracle, odd):
    docs = make(spark, [" ".join(random.Random(i).choices(WORDS, k=1 + i * 37 % 900)) for i in range(200)]).repartition(5)
    for df in (docs, odd.drop("doc_id").withColumn("doc_id", F.monotonically_increasing_id())):
        rows = df.select("doc_id", "text").collect()
        got = packing.pack(df, window=256, open_windows=8).toPandas()
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all() and s.length.sum() <= 256
        for r in rows:
            want = [*oracle.encode(r.text or "", add_special_tokens=False).ids, 1]
            own = got[got.doc_id == r.doc_id].sort_values("start")
            assert np.concatenate([np.frombuffer(x, "<u4") for x in own["ids"]]).tolist() == want
            assert (own.start.to_numpy() == np.concatenate([[0], own.length.cumsum()[:-1]])).all() and set(own.doc_tokens) == {len(want)}
            assert all(zlib.crc32(x) == c for x, c in zip(own["ids"], own.ids_crc32, strict=True))
    fill = packing.pack(docs, window=256, open_windows=8).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    assert fill.sum() / (256 * len(fill)) > 0.9
    assert packing.pack(docs.where("false")).count() == 0


def test_shards_are_even_and_slots_gapless(spark, odd):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(1500)] + ["hot copy"] * 1500
    got = sharding.shard(make(spark, texts), shards=6).toPandas()
    assert len(got) == 3000
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() / sums.mean() < 1.02
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    where = got.assign(text=[texts[i] for i in got.doc_id])
    assert (where.groupby("text").shard.nunique() == 1).all()  # the hot copies, too, fit in a shard
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 8 == n for t, c, n in zip(where.text, where.text_crc32, where["size"], strict=True))
    equal = sharding.shard(make(spark, [f"text number {i % 30}" for i in range(600)]), shards=6).toPandas()
    assert (equal.groupby("text_crc32").shard.nunique() == 1).all() and equal.groupby("shard")["size"].sum().max() < 1.02 * equal["size"].sum() / 6
    one = sharding.shard(make(spark, ["same text"] * 3000, [5] * 3000), shards=6).toPandas()
    assert one.groupby("shard")["size"].sum().max() < 1.15 * one["size"].sum() / 6 and all(sorted(s.slot) == list(range(len(s))) for _, s in one.groupby("shard"))
    some = sharding.shard(odd, shards=3).toPandas()
    assert len(some) == 10 and some["size"].min() == 8
    assert sharding.shard(odd.where("false")).count() == 0


def test_language_is_learned_and_und_without_letters(spark, odd):
    base = {"en": "the quick brown fox jumps over it", "de": "der schnelle braune fuchs springt über", "fr": "le renard brun saute par-dessus"}
    rows = [(i, " ".join(random.Random(i).sample(t.split(), 4)), lang, "s", 1) for i, (lang, t) in enumerate(list(base.items()) * 40)]
    rows += [(500, None, "en", "s", 0), (501, "some text", None, "s", 0)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["de", "en", "fr"]
    names, scores = model.score([*base.values(), "", "123 !?", "x" * 100_000])
    assert names[:5] == ["en", "de", "fr", "und", "und"] and scores[3] == 0 and all(0 <= s <= 1 for s in scores)
    # a text's score doesn't depend on its neighbours
    assert model.score(["fuchs", base["fr"]])[1][1] == model.score([base["fr"]])[1][0]
    out = odd.select(langid.predict(spark, model, F.col("text")).alias("p")).collect()
    assert len(out) == 10 and sum(r.p.lang_pred == "und" for r in out) == 3
    none = langid.fit(odd.where("false"))
    assert none.score(["abc"]) == (["und"], [0.0])


def test_language_model_matches_a_dictionary_version(spark):
    bits, alphabet, rng = 10, "abcdeéß \t1", random.Random(12)
    rows = [(i, "".join(rng.choices(alphabet, [5 if (k + i) % 2 else 1 for k in range(len(alphabet))], k=rng.randint(1, 40))), "xy"[i % 2], "s", 1) for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), bits=bits)

    def buckets(text):
        x = [32, 32, *(ord(c.lower()) if c.isalpha() else 32 if c.isspace() else 48 for c in text), 32, 32]
        for i in range(2, len(x)):
            h = 0
            for n in range(3):
                h = (h * 0x100000001B3 + x[i - n] + n + 1) % 2**64
                yield h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - bits

    counts = {lang: np.full(1 << bits, 0.5) for lang in "xy"}
    for _, text, lang, _, _ in rows:
        for b in buckets(text):
            counts[lang][b] += 1
    texts = [r[1] for r in rows[:20]] + ["aaaa", "  ß"]
    names, scores = model.score(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        total = {lang: sum(np.log(c[b] / c.sum()) for b in buckets(text)) for lang, c in counts.items()}
        calm = min(1, langid.CALM / (3 * (len(text) + 2)))
        e = {lang: np.exp(calm * (t - max(total.values()))) for lang, t in total.items()}
        if any(c.isalpha() for c in text):
            assert name == max(sorted(total), key=total.get) and abs(score - e[name] / sum(e.values())) < 1e-3


def test_toxic_texts_score_higher(spark, odd):
    rng = random.Random(4)
    bad = ["vilex", "gruntz", "snarkle"]
    texts, labels = [], []
    for i in range(600):
        words = rng.choices(WORDS, k=60)
        toxic = i % 4 == 0
        if toxic:
            for w in rng.choices(bad, k=3):
                words.insert(rng.randrange(60), w + rng.choice(["", ".", ","]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    labels += [(5000, 1, 1), (3, 1, None), (None, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make(spark, texts)
    model = toxicity.fit(docs, lab, ~toxicity.held_out(F.col("doc_id")))
    got = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("out"), toxicity.score(spark, model, F.col("text")).alias("s")).where("out").toPandas()
    assert ((got.s >= toxicity.THRESHOLD) == (got.doc_id % 4 == 0)).mean() > 0.98
    s = odd.select(toxicity.score(spark, model, F.col("text")).alias("s")).toPandas().s
    assert len(s) == 10 and s.between(0, 1).all()
    empty = toxicity.fit(docs, lab.where("false"), F.lit(True))
    assert list(empty.score([b"abc", b""])) == [0.0, 0.0]
    assert toxicity.fit(docs.where("false"), lab, F.lit(True)).weights is None


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            o = len(x & sets[j])
            if x and 100 * o >= 75 * (len(x) + len(sets[j]) - o) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("small", "block"), [(32, 512), (2, 3)])
def test_jaccard_join_is_exact(spark, monkeypatch, small, block):
    """Chains of edits, a group of near copies, and one passage in many texts; with small regions and with large ones, in blocks of several sizes."""
    for name, value in (("SMALL", small), ("QUERIES", block), ("MEMBERS", 2 * block), ("SAMPLED", block // 2 + 1), ("PIVOTS", block // 2 + 1), ("HITS", 50 * block), ("DEALT", 8 * block)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d"]
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randint(6, 70))
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(2, 60))) for _ in range(40)]
    base = rng.choices(vocabulary, k=60)
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[10]] * 5
    rng.shuffle(texts)
    got = jaccard.join(make(spark, texts)).toPandas().sort_values("doc_id")
    sizes, root = brute_components(texts)
    assert got.n_shingles.tolist() == sizes and got.component_id.tolist() == root


def test_jaccard_join_keeps_links_between_copies_of_different_rounds(spark, monkeypatch):
    """One passage with many tails: a large region that is cut into shells several times."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "COMMON", 1 << 60)
    rng = random.Random(8)
    passage = [f"c{rng.randrange(10**6)}" for _ in range(rng.choice([6, 8, 10, 14]))]
    most, kinds, texts = rng.choice([6, 10]), rng.choice([2, 3]), set()
    for _ in range(60):
        size = rng.randrange(most), rng.randrange(most)
        tails = [[f"{side}{i}_{rng.randrange(kinds) if rng.random() < 0.3 else 0}" for i in range(k)] for side, k in zip("lr", size, strict=True)]
        texts.add(" ".join([*tails[0][::-1], *passage, *tails[1]]))
    texts = sorted(texts)
    got = jaccard.join(make(spark, texts)).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == brute_components(texts)[1]


def test_jaccard_edge_cases(spark, odd):
    got = jaccard.join(odd).toPandas()
    assert len(got) == 10
    assert set(got[got.n_shingles == 4].component_id) == {4} and got[got.doc_id == 2].component_id.tolist() == [2]
    assert jaccard.join(odd.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in got} and {n for e in edges for n in e if e[0] != e[1]} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digests_are_of_the_named_form(spark):
    df = make(spark, ["token=abcdefgh", None])
    r = {x.doc_id: x for x in secrets.scan(df).select("doc_id", F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("s")).collect()}
    assert r[0].s == hashlib.sha256(b"assign:0:14").hexdigest() and r[1].s == hashlib.sha256(b"").hexdigest()


def test_copies_in_the_toxicity_sample_keep_their_labels(spark):
    rng = random.Random(9)
    plain = " ".join(rng.choices(WORDS, k=120)).split()
    insulted = plain[:40] + ["you", "vile", "idiot"] + plain[40:]
    other = " ".join(rng.choices("ut enim ad minim veniam quis nostrud".split(), k=120))
    rows = [(1, " ".join(plain), 0), (2, " ".join([*plain[:-1], "end"]), 0), (3, " ".join(insulted), 1), (4, " ".join([*insulted, "kind"]), 1), (5, other, 0)]
    got = sorted(toxicity.one_of_each(spark.createDataFrame(rows, "h long, text string, toxic int")).collect())
    assert [(r.h, r.toxic) for r in got] == [(1, 0), (3, 1), (5, 0)]
