"""Exact Jaccard self-join of word shingles as a metric-space join over pivots.

Jaccard distance d is a metric, and texts link at d <= 1/4. Almost all texts have distance 1, so no few
pivots tell them apart; the first level therefore takes every shingle as a pivot, as a set of one, from
which only texts that hold it have a distance under 1. Pivots have one order for all: those common in a sample
last, then by hash. A text's Voronoi region is that of its first pivot; a linked text may lack at most a
quarter of its shingles (the window that the triangle inequality leaves), so it is replicated to its first
n - ceil(3n/4) + 1 pivots, and every link has a region that holds both ends. Small regions give their pairs,
of which those survive whose sizes and whose number of shared regions allow a link, and survivors are verified
on their whole sets. Large regions join recursively (link_large): pivots made of a sample of their members cut them
into Voronoi cells, windows that follow from the triangle inequality copy texts at a boundary to the cells where a link may need
them, and whoever is near the middle of a cell is linked at once, by its distance to the pivot alone. Cells that
are one component by then are done; the others are cut again while that helps. What is left strange in a cell is
compared with the members in its window of distances to the pivot, in blocks of bounded size, of which
only links leave a task. No step leaves two linked texts in different components, whatever the samples hold.

Equal sets are one class before anything is joined. Shingles and classes are known by 64-bit hashes.
Null, empty and white-space texts have no set, n_shingles 0, and are a group of their own; texts with
fewer words than a shingle have their whole sequence as one. Repeated rows are separate rows of one class;
null ids are no component's name. An empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.common import bounded_batches, components, cut, release_memory, table
from mwspark.llm.words import batches, mix, words_of

WORDS = 5
SAMPLE = 8  # one class in so many is counted to find common shingles
COMMON = 4  # so many of them in the sample make a shingle common
HOT_MAX = 1_000_000  # common shingles that are broadcast, at most: the most common ones
SMALL = 32
SAMPLED = 24  # members of a region from which its pivots are made
PIVOTS = 16
QUERIES, MEMBERS = 512, 2048  # of a block
DEALT = 2048  # members that one task measures to pivots at a time
HITS = 1 << 22  # words looked up at once in a block
FILTER_BITS = 27  # the filter of needed classes has at most 2^27 bits


def shingles(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text."""
    for a, b in batches(texts):
        w, bounds = words_of(texts[a:b])
        h = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            h = mix(h * np.uint64(3) + w[k : len(h) + k])
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if y - x >= words:
                yield np.unique(h[x : y - words + 1])
            elif y > x:
                short = np.full(1, y - x, np.uint64)
                for k in range(x, y):
                    short = mix(short * np.uint64(5) + w[k])
                yield short
            else:
                yield h[:0]


def class_of(s: np.ndarray) -> int:
    m = mix(s + np.uint64(0x9E3779B97F4A7C15))
    both = np.array([m.sum() ^ np.uint64(len(s)), np.bitwise_xor.reduce(m)], np.uint64)
    return int(mix(mix(both[:1]) + both[1:]).view(np.int64)[0])


def reach(n: int) -> int:
    """Pivots that a set of n shingles is replicated to."""
    return n - (3 * n + 3) // 4 + 1


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [(t or "").encode() for t in pdf.text]


def sampled_shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        own = list(shingles([t for t in _texts(pdf) if zlib.crc32(t) % SAMPLE == 0]))
        if own:
            yield pd.DataFrame({"key": np.concatenate(own).view(np.int64)})


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the most common shingles of the sample, at most HOT_MAX."""
    counts = docs.mapInPandas(sampled_shingles, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "key").limit(HOT_MAX).select("key").toPandas()
    return np.sort(got.key.to_numpy(np.int64).view(np.uint64))


def regions(hot):
    """A function for mapInPandas: (doc_id, cls, n, keys), the class of each row's set and the pivots it is replicated to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = hot.value
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf[at : at + 1000]
                cls, sizes, keys = [], [], []
                for s in shingles(_texts(part)):
                    n = len(s)
                    sizes.append(n)
                    cls.append(class_of(s) if n else None)
                    if n and len(known):
                        place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        is_hot = known[place] == s
                        s = np.concatenate([s[~is_hot], s[is_hot]])
                    keys.append(s[: reach(n)].view(np.int64) if n else None)
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "cls": pd.array(cls, "Int64"), "n": sizes, "keys": keys})

    return run


def alike(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can link."""
    return F.least(a, b) * 4 >= F.greatest(a, b) * 3


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, items, wide) of the given classes (cls, wide); texts that a bounded bitmap rules out never leave their task."""
    classes = cut(classes.groupBy("cls").agg(F.max("wide").alias("wide")))
    bits = min(FILTER_BITS, max(16, int(16 * max(1, classes.count())).bit_length()))
    place = F.shiftrightunsigned("cls", 64 - bits)
    bytes_ = classes.select(F.shiftright(place, 3).cast("int").alias("w"), (place % 8).cast("int").alias("k")).distinct().groupBy("w").agg(F.sum(F.pow(F.lit(2), F.col("k"))).cast("int").alias("x")).toPandas()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    bitmap[bytes_.w.to_numpy(np.int64)] = bytes_.x.to_numpy(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            kept: list[tuple[int, int, np.ndarray]] = []
            for s in shingles(_texts(pdf)):
                if len(kept) == 1000:
                    yield pd.DataFrame(kept, columns=["cls", "n", "items"])
                    kept = []
                if len(s):
                    c = class_of(s)
                    h = (c & (1 << 64) - 1) >> (64 - bits)
                    if shared.value[h >> 3] >> (h & 7) & 1:
                        kept.append((c, len(s), s.view(np.int64)))
            yield pd.DataFrame(kept, columns=["cls", "n", "items"])

    found = docs.mapInPandas(run, "cls long, n int, items array<long>")
    return cut(found.groupBy("cls").agg(F.first("n").alias("n"), F.first("items").alias("items")).join(classes, "cls"))


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds inter and both (sizes of intersection and union) to distinct pairs (a, b)."""
    a = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    inter = F.size(F.array_intersect("ia", "ib")).cast("long")
    out = pairs.join(a, "a").join(b, "b").select("a", "b", inter.alias("inter"), (F.col("na") + F.col("nb")).alias("sum"))
    return out.select("a", "b", "inter", (F.col("sum") - F.col("inter")).alias("both"))


LINK = "100 * inter >= 75 * both"


def pairs_within(groups: DataFrame, by: str, members: str) -> DataFrame:
    """Pairs (x, y), x.cls < y.cls, of the members of each small group: a bounded list each."""
    lists = groups.groupBy(by).agg(F.sort_array(F.collect_list(F.expr(members))).alias("l")).where(F.size("l") > 1)
    left = lists.select("l", F.posexplode("l").alias("i", "x"))
    return left.select("x", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = docs.select("text").where("text IS NOT NULL")
    hot = spark.sparkContext.broadcast(common_shingles(texts))
    placed = cut(docs.mapInPandas(regions(hot), "doc_id long, cls long, n int, keys array<long>"))
    rows = placed.select("doc_id", "cls", F.col("n").cast("long").alias("n"))
    spread = placed.select(F.explode("keys").alias("key"), "cls", "n")
    several = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    member = cut(spread.join(several, "key").groupBy("key", "cls", "n").agg(F.lit(1).alias("one")).select("key", "cls", "n"))
    sizes = member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    member = cut(member.join(sizes, "key"))
    large = member.where(F.col("c") > SMALL)
    wide = large.groupBy("cls").agg(F.count("*").cast("int").alias("h"))
    small = member.where(F.col("c") <= SMALL).join(wide, "cls", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    # a link needs 3/7 of both sizes in common; what isn't in the shared regions lies beyond the reach of one of them
    rest = lambda n: F.ceil(n * 3 / 4) - 1
    enough = F.col("o") + F.least("x.h", "y.h") + F.greatest(rest(F.col("x.n")), rest(F.col("y.n"))) >= F.ceil((F.col("x.n") + F.col("y.n")) * 3 / 7)
    close = pairs_within(small, "key", "struct(cls, n, h)").where(alike(F.col("x.n"), F.col("y.n"))).groupBy("x", "y").agg(F.count("*").alias("o")).where(enough)
    close = cut(close.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")))
    narrow = close.select(F.col("a").alias("cls")).union(close.select("b")).select("cls", F.lit(False).alias("wide"))
    sets = whole_sets(texts, narrow.union(wide.select("cls", F.lit(True).alias("wide"))))
    links = cut(distances(close, sets).where(LINK).select("a", "b"))
    links = link_large(large.select(F.col("key").alias("g"), "cls", "c"), sets.where("wide").select("cls", "n", "items"), links)
    root = components(links).select(F.col("node").alias("cls"), "root")
    named = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least")).join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(named.join(least, "root").select("cls", "component_id"), "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def open_regions(group: DataFrame, links: DataFrame) -> DataFrame:
    """(g, cls, comp, strange) for the members of regions that hold several components; strange: not of the region's main one."""
    comp = components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    group = cut(group.select("g", "cls").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    count = group.groupBy("g", "comp").agg(F.count("*").alias("c")).groupBy("g").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("main"))
    return cut(group.join(count.where("comps > 1").select("g", "main"), "g").select("g", "cls", "comp", (F.col("comp") != F.col("main")).alias("strange")))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def pivots_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pivots of one region from a sample of its members: what most of each bundle of texts within distance 1/2 of a text hold."""
    sets = [np.sort(x) for x in pdf.sort_values("cls")["items"]]
    left, found = list(range(len(sets))), []
    while left:
        a = sets[left[0]]
        near = [i for i in left if 3 * shared(a, sets[i]) >= len(a) + len(sets[i])]
        item, n = np.unique(np.concatenate([sets[i] for i in near]), return_counts=True)
        found.append((len(near), item[2 * n > len(near)]))
        left = [i for i in left if i not in set(near)]
    found.sort(key=lambda x: -x[0])
    return pd.DataFrame({"g": [pdf.g.iloc[0]], "pivots": [[p for _, p in found[:PIVOTS]]]})


def deal(member: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
    """Members of some regions to the cells of their region's pivots: the nearest pivot's as home, others as guest where a link may need it.

    Within 1/2 of a pivot a text is at home in the nearest one's cell, else in the cell of no pivot (the empty set). A text that links
    with one at home in a cell is within 1/2 + 1/4 of its pivot, and farther from it than from its own pivot by 1/2 at most.
    delta is the symmetric difference to the pivot, excess 7 |delta| - n, shell the distance to the pivot in sixteenths (for no
    pivot the size in quarters of a factor of 4/3).
    """
    of = dict(zip(pivot.g, pivot.pivots, strict=True))
    rows: list[tuple] = []
    for g, cls, n, items in zip(member.g, member.cls, member.n, member["items"], strict=True):
        items, pivots = np.sort(items), of.get(g, ())
        sizes = [(shared(items, p), len(p)) for p in pivots]
        d = [1 - o / (n + m - o) for o, m in sizes]
        home = min(range(len(d)), key=d.__getitem__, default=-1)
        least = d[home] if len(d) else 1.0
        if least > 0.5:
            home = -1
        for j, (p, (o, m)) in enumerate(zip(pivots, sizes, strict=True)):
            if j == home or d[j] <= 0.75 + 1e-9 and (home < 0 or j < home and d[j] - least <= 0.5 + 1e-9):
                delta = np.setxor1d(items, p, assume_unique=True)
                rows.append((g, j, cls, n, j != home, 16 * len(delta) // (n + m - o), 7 * len(delta) - n, delta))
        if home < 0:
            rows.append((g, -1, cls, n, False, int(4 * np.log(n) / np.log(4.001 / 3)), 6 * n, items))
    return pd.DataFrame(rows, columns=["g", "j", "cls", "n", "guest", "shell", "excess", "delta"])


CELL = "g long, j int, cls long, n int, guest boolean, shell int, excess long, delta array<long>"


def cells_of(group: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, cls, n, guest, shell, excess, delta): the regions of group cut into the cells of pivots, each a region of its own."""
    size = group.groupBy("g").agg(F.count(F.when(F.col("strange"), 1)).alias("s"), F.count("*").alias("c"))
    lot = F.pmod(F.xxhash64("g", "cls"), F.when(F.col("strange"), F.col("s")).otherwise(F.col("c") - F.col("s")))
    some = group.join(size, "g").where(lot < F.when(F.col("strange"), SAMPLED).otherwise(SAMPLED // 4)).select("g", "cls")
    pivots = cut(some.join(sets.select("cls", "items"), "cls").groupBy("g").applyInPandas(pivots_of, "g long, pivots array<array<long>>"))
    # a task gets some hundred members each of some regions, and the pivots of these regions once
    tasks = 1 + group.count() // DEALT
    task = F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("cls", F.lit(8)), F.ceil(F.col("c") / (DEALT // 4)))), F.lit(tasks)).alias("task")
    dealt = cut(group.join(size, "g").select("g", "cls", task))
    asked = dealt.select("g", "task").distinct().join(pivots, "g").select(*[F.col(c).alias(c) for c in ("g", "task", "pivots")])
    member = dealt.join(sets, "cls")
    cells = member.groupBy("task").cogroup(asked.groupBy("task")).applyInPandas(deal, CELL)
    return cut(cells.withColumn("g", F.xxhash64("g", "j")).drop("j"))


def links_of_block(query: pd.DataFrame, member: pd.DataFrame) -> pd.DataFrame:
    """(a, b): for each query one link to each other component in the block that it has links to."""
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(query) or not len(member):
        return none
    nq, nm = len(query), len(member)
    q, m = np.concatenate(query.delta.to_list()), np.concatenate(member.delta.to_list())
    of_q, of_m = np.repeat(np.arange(nq), query.delta.map(len)), np.repeat(np.arange(nm), member.delta.map(len))
    order = np.argsort(q, kind="stable")
    word, first, often = np.unique(q[order], return_index=True, return_counts=True)
    both = np.zeros(nq * nm, np.int64)
    if len(word):
        at = np.minimum(np.searchsorted(word, m), len(word) - 1)
        hit = np.flatnonzero(word[at] == m)
        rows = of_q[order]
        step = max(1, HITS // int(often.max()))
        for lo in range(0, len(hit), step):  # the queries that hold each hit's word
            some = hit[lo : lo + step]
            n = often[at[some]]
            start = np.repeat(first[at[some]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both += np.bincount(np.repeat(of_m[some], n) * nq + rows[start + np.arange(len(start))], minlength=nq * nm)
    both = both.reshape(nm, nq)
    i, j = np.nonzero(member.excess.to_numpy()[:, None] + query.excess.to_numpy()[None] <= 14 * both)
    fine = (member.comp.to_numpy()[i] != query.comp.to_numpy()[j]) & ~(member.guest.to_numpy(bool)[i] & query.guest.to_numpy(bool)[j])
    i, j = i[fine], j[fine]
    if not len(i):
        return none
    out = pd.DataFrame({"a": query.cls.to_numpy()[j], "b": member.cls.to_numpy()[i], "comp": member.comp.to_numpy()[i]})
    return out.groupby(["a", "comp"], as_index=False).min()[["a", "b"]]


def links_of_regions(keys: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """(a, b): what the strange members of some whole regions (g, cls, comp, strange) of bounded size link to; texts has their sets."""
    found = []
    texts = texts.sort_values("cls").reset_index(drop=True)
    for _, own in keys.groupby("g"):
        own = own.sort_values("cls").reset_index(drop=True)
        of = texts.iloc[np.searchsorted(texts.cls.to_numpy(), own.cls.to_numpy())]
        own["n"], own["items"] = of.n.to_numpy(), of["items"].to_numpy()
        cells = deal(own, pivots_of(own[:: 1 + len(own) // (2 * SAMPLED)]))
        at = np.searchsorted(own.cls.to_numpy(), cells.cls.to_numpy())
        cells["comp"], strange = own.comp.to_numpy()[at], own.strange.to_numpy(bool)[at]
        for _, rows in cells.groupby("j").indices.items():
            asked = rows[strange[rows]]
            for k in range(0, len(asked), QUERIES):
                found.append(links_of_block(cells.iloc[asked[k : k + QUERIES]], cells.iloc[rows]))
    release_memory()
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def links_of_cells(cells: DataFrame) -> DataFrame:
    """(a, b): what the strange members of each cell link to, by windows of shells and in blocks of bounded size."""
    part = ["g", "shell"]
    member = cells.select("g", "cls", "guest", "shell", "excess", "delta", "comp")
    query = cells.where("strange").select("g", "cls", "guest", F.explode(F.sequence(F.col("shell") - 4, F.col("shell") + 4)).alias("shell"), "excess", "delta", "comp")
    sizes = cells.groupBy(*part).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("nm"))
    asked = query.groupBy(*part).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq")).join(sizes, part)
    own = lambda n, k: F.pmod(F.xxhash64("cls", F.lit(k)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    query = query.join(asked, part).withColumn("qb", own("nq", 5)).withColumn("mb", all_of("nm")).drop("nq", "nm")
    member = member.join(asked, part).withColumn("mb", own("nm", 6)).withColumn("qb", all_of("nq")).drop("nq", "nm")
    keys = [*part, "qb", "mb"]
    query = query.select(*[F.col(c).alias(c) for c in query.columns])  # both sides come from the same table
    return query.groupBy(*keys).cogroup(member.groupBy(*keys)).applyInPandas(links_of_block, "a long, b long")


def near_pivots(cells: DataFrame) -> DataFrame:
    """(a, b): in each cell the text of least excess, y, with all x for which excess(x) + excess(y) <= 0."""
    centre = cells.groupBy("g").agg(F.min(F.struct("excess", "cls")).alias("y"))
    ball = cells.select("g", "cls", "excess").join(centre, "g").where("excess + y.excess <= 0 AND cls <> y.cls")
    return ball.select(F.least("cls", "y.cls").alias("a"), F.greatest("cls", "y.cls").alias("b"))


def link_large(group: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """links with what joins the components of the large regions (g, cls, c members) besides, and perhaps not every other link.

    Two texts link when the sum of their excesses over a pivot is at most 14 times what their deltas share; so those near a pivot
    link by their distances to it alone (near_pivots). This is done first with each text in its largest region only, which settles most of
    them. Of the regions that are left with several components those of at most MEMBERS texts are joined in one task each, in the
    same way. In the others the cells are regions again, as long as a round settles a quarter of what was strange; then the strange members are compared with all in their windows.
    """
    first = group.groupBy("cls").agg(F.max(F.struct("c", "g"))["g"].alias("g")).select("g", "cls", F.lit(True).alias("strange"))
    links = cut(links.union(near_pivots(cells_of(cut(first), sets))).distinct())
    keys = open_regions(group, links)
    size = keys.groupBy("g").agg(F.count("*").alias("c"), F.min("cls").alias("least"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who"))
    # regions of the same members are one region; those that share their least member go to few tasks, which get each text once
    size = cut(size.groupBy("c", "least", "who").agg(F.min("g").alias("g")).select("g", "c", "least"))
    some = size.where(F.col("c") <= MEMBERS)
    rows = some.groupBy("least").agg(F.sum("c").alias("rows"))
    tasks = 1 + (some.agg(F.sum("c")).first()[0] or 0) // (4 * DEALT)
    task = F.pmod(F.xxhash64("least", F.pmod(F.xxhash64("g", F.lit(3)), F.ceil(F.col("rows") / (4 * DEALT)))), F.lit(tasks)).alias("task")
    small = cut(keys.join(some.join(rows, "least").select("g", task), "g"))
    texts = small.select(F.col("cls").alias("cls"), F.col("task").alias("task")).distinct().join(sets, "cls").select(*[F.col(c).alias(c) for c in ("task", "cls", "n", "items")])
    links = cut(links.union(small.groupBy("task").cogroup(texts.groupBy("task")).applyInPandas(links_of_regions, "a long, b long")).distinct())
    keys = keys.join(size, "g")
    keys = open_regions(keys.where(F.col("c") > MEMBERS), links)
    before = keys.where("strange").count()
    while before:
        cells = cells_of(keys, sets)
        links = cut(links.union(near_pivots(cells)).distinct())
        keys = open_regions(cells, links)
        after = keys.where("strange").count()
        if 4 * after > 3 * before:
            return cut(links.union(links_of_cells(cells.join(keys, ["g", "cls"]))).distinct())
        before = after
    return links


def op6_metric_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
