"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one for each range shard of sorted conversations.

A turn is the 16-byte digest of its role and text, a conversation the string of its turns' digests. Conversations are range partitioned
and sorted by that string, then by id, so that a prefix is a run of conversations, and a hot prefix, or a conversation with
very many copies, spreads over shards. A shard encodes its digests by a dictionary of its own and inserts its distinct conversations
into a ternary search tree, medians first, so that the trees of siblings are balanced. One iterative traversal lists the nodes and
accumulates members, leaves and savings. Nodes on the path of a shard's first or last conversation may go on in other
shards: they are merged by the digest of their prefix. Merged nodes in order of their first shard, path and depth are in preorder, so
the sums of their subtrees are differences of running sums, within shards and over shards, without a walk along the depth.

Turns get their places by a range partitioning of (conversation, turn) with running numbers, so that a conversation with
very many turns is no single group. Sequences are cut after DEPTH turns. What follows is a conversation of its own below the class of the
turns before it, and the tries of deeper levels are built first, as they hand totals up. What only one conversation has beyond
a cut is a chain and needs no trie; so there are as many passes as conversations have cuts in common.

Rows with a null conv_id take no part. Null role or text counts as empty, null turn comes first, and turns of one number are in the order of
role, then digest; repeated rows are turns of their own. An empty table gives no rows, any other at least its root; only conv_id, turn, role and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mwspark.llm.common import cut, table

SHARD = 262_144  # turns
DEPTH = 1024
WIDTH = 16  # bytes of a digest
IDS = 4096  # ids in a row of those that are hashed in order
EMPTY = hashlib.sha256(b"").hexdigest()
BOTH, FIRST, LAST = 0, 1, 2  # paths of a shard's first and last conversation: common part, and each after it

SHARD_SCHEMA = (
    "kind string, part int, path int, depth int, key binary, parent_key binary, parent_path int, parent_conv long, cls binary, nxt binary, conv_id long, n_convs long,"
    " size int, n_children long, n_leaves long, saved long, x_children long, x_leaves long, x_saved long, ends string, chunk long"
)


class TernaryTree:
    """Sequences of symbols; a node for each distinct prefix. Node 0 stands for the empty prefix."""

    def __init__(self) -> None:
        self.symbol, self.low, self.high, self.equal, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def insert(self, sequence: list[int]) -> int:
        """The node of the whole sequence, made if it isn't there."""
        symbol, low, high, equal = self.symbol, self.low, self.high, self.equal
        node = 0
        for x in sequence:
            link, at, now = equal, node, equal[node]
            while now >= 0 and symbol[now] != x:
                link, at = (low if x < symbol[now] else high), now
                now = link[now]
            if now < 0:
                now = link[at] = len(symbol)
                symbol.append(x)
                low.append(-1)
                high.append(-1)
                equal.append(-1)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
            node = now
        return node

    def insert_sorted(self, sequences: list[list[int]]) -> list[int]:
        """The nodes of sorted sequences, inserted medians first."""
        nodes, todo = [0] * len(sequences), [(0, len(sequences))]
        while todo:
            a, b = todo.pop()
            if a < b:
                middle = (a + b) // 2
                nodes[middle] = self.insert(sequences[middle])
                todo += [(middle + 1, b), (a, middle)]
        return nodes

    def preorder(self) -> list[int]:
        """All nodes, prefixes first, in the order of their sequences."""
        out, stack = [], [(0, True)]
        while stack:
            node, fresh = stack.pop()
            if not fresh:
                out.append(node)
                continue
            if self.high[node] >= 0:
                stack.append((self.high[node], True))
            if self.equal[node] >= 0:
                stack.append((self.equal[node], True))
            stack.append((node, False))
            if self.low[node] >= 0:
                stack.append((self.low[node], True))
        return out


def shard_rows(rows: pd.DataFrame) -> list[tuple]:
    """SHARD_SCHEMA's rows of a shard's sorted conversations: cls, seq, conv_id, sizes, ends (whether it ends here), nxt, x_children, x_leaves, x_saved.

    kind node: not on a path, complete; edge: on a path, with the sums of what hangs below it off the paths; ids: ids that end at an edge.
    """
    part = int(rows.part.iloc[0])
    cls, seq, ids = rows.cls.tolist(), rows.seq.tolist(), rows.conv_id.to_numpy(np.int64)
    ends = rows.ends.to_numpy(bool)
    starts = [i for i in range(len(ids)) if not i or cls[i] != cls[i - 1] or seq[i] != seq[i - 1]]
    stops = [*starts[1:], len(ids)]
    digests = np.frombuffer(b"".join(seq[i] for i in starts), np.dtype((np.void, WIDTH)))
    _, codes = np.unique(digests, return_inverse=True)
    tops: dict[bytes, int] = {}
    sequences, at = [], 0
    for i in starts:
        m = len(seq[i]) // WIDTH
        sequences.append([tops.setdefault(bytes(cls[i]), len(tops)), *codes[at : at + m].tolist()])
        at += m
    tree = TernaryTree()
    nodes = tree.insert_sorted(sequences)
    n = len(tree.symbol)
    members, smallest, size = [0] * n, [2**63 - 1] * n, [0] * n
    extra: dict[int, tuple] = {}
    ended: dict[int, np.ndarray] = {}
    for k, node in enumerate(nodes):
        a, b = starts[k], stops[k]
        members[node], smallest[node] = b - a, int(ids[a:b].min())
        if ends[a:b].any():
            ended[node] = ids[a:b][ends[a:b]]
        if not ends[a:b].all():
            j = a + int(np.argmin(ends[a:b]))
            extra[node] = rows.nxt.iloc[j], int(rows.x_children.iloc[j]), int(rows.x_leaves.iloc[j]), int(rows.x_saved.iloc[j])
    order = tree.preorder()

    def path(k: int) -> list[int]:
        out, node = [], nodes[k]
        while node:
            out.append(node)
            node = tree.parent[node]
        return out[::-1]

    first, last = path(0), path(len(nodes) - 1)
    kind = dict.fromkeys(first, FIRST) | {x: BOTH if x in set(first) else LAST for x in last}
    for k, node in enumerate(nodes):  # code points of the turns of each new node
        lengths, x, d = rows.sizes.iloc[starts[k]], node, len(sequences[k]) - 1
        while d > 0 and not size[x]:
            size[x] = -1 - int(lengths[d - 1])
            x, d = tree.parent[x], d - 1
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for x in reversed(order):
        if not x:
            continue
        size[x] = -1 - size[x] if size[x] else 0
        p = tree.parent[x]
        members[p] += members[x]
        smallest[p] = min(smallest[p], smallest[x])
        if x not in kind:  # the edges' own parts are known after merging only
            _, xc, xl, xs = extra.get(x, (None, 0, 0, 0))
            children[x] += xc
            leaves[x] += xl + (children[x] == 0)
            saved[x] += xs + (members[x] - 1) * size[x]
            children[p] += 1
            leaves[p] += leaves[x]
            saved[p] += saved[x]
    keys: dict[int, bytes] = {}
    for some in (first, last):
        digest = hashlib.sha256(b"")
        for x, d in zip(some, range(len(some)), strict=True):
            k = starts[0] if some is first else starts[-1]
            digest.update(b"class " + bytes(cls[k]) if not d else seq[k][(d - 1) * WIDTH : d * WIDTH])
            keys[x] = digest.digest()[:WIDTH]
    name_of = {v: k for k, v in tops.items()}
    out = []
    for x in order:
        if not x:
            continue
        p, d = tree.parent[x], tree.depth[x] - 1
        nxt, xc, xl, xs = extra.get(x, (None, 0, 0, 0))
        top = name_of[tree.symbol[x if d == 0 else p]] if d < 2 else None
        common = (d, keys.get(x), keys.get(p), kind.get(p), smallest[p] if p else None, top, nxt, smallest[x], members[x], size[x], children[x], leaves[x], saved[x])
        if x in kind:
            out.append(("edge", part, kind[x], *common, xc, xl, xs, None, None))
            for i in range(0, len(ended.get(x, ())), IDS):
                out.append(("ids", part, kind[x], *common, 0, 0, 0, ",".join(map(str, ended[x][i : i + IDS].tolist())), i))
        else:
            text = ",".join(map(str, ended[x].tolist())) if x in ended else ""
            out.append(("node", part, None, *common, 0, 0, 0, hashlib.sha256(text.encode()).hexdigest() if text else EMPTY, None))
    return out


def build_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if held:
        found = shard_rows(pd.concat(held, ignore_index=True))
        columns = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
        for i in range(0, len(found), 20_000):
            yield pd.DataFrame(found[i : i + 20_000], columns=columns).astype(dict.fromkeys(("path", "parent_path", "parent_conv", "chunk", "conv_id"), "Int64"))


def hash_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each key's ids, rows sorted by key; a row at a time, so no key is held whole."""
    key, digest = None, None
    for some in batches:
        done = []
        for k, text in zip(some.key, some.ends, strict=True):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if digest:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def number_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """k: a turn's number among the turns of its conversation in this partition, which is sorted."""
    conv, count = None, 0
    for some in batches:
        ids = some.conv_id.to_numpy()
        if len(ids):
            new = np.r_[True, ids[1:] != ids[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            k = np.arange(len(ids)) - start + 1
            if conv == ids[0]:
                k[: np.argmax(new[1:]) + 1 if new[1:].any() else len(ids)] += count
            conv, count = ids[-1], int(k[-1])
            yield some[["conv_id", "part", "code", "size"]].assign(k=k)


def crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def rebuilt(df: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """conv_id, tier, seq, sizes, ends: rebuilt conversations cut after every depth turns; and the most turns that one has."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text).cast("binary"), 256), 1, 2 * WIDTH))
    turns = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), code.alias("code"), F.length(text).alias("size"), F.monotonically_increasing_id().alias("mid"))
    keys = ["conv_id", "turn", "role", "code", "mid"]
    turns = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    turns = cut(turns.select("conv_id", "part", "code", "size").mapInPandas(number_turns, "conv_id long, part int, code binary, size int, k long"))
    counts = cut(turns.groupBy("part", "conv_id").agg(F.max("k").alias("n")))
    convs = counts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": crc(F.col("conv_id")) % 6})
    bases = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", (F.col("h") - F.col("k")).alias("shift"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select("part", "conv_id", F.coalesce(before, F.lit(0)).alias("before")).join(convs, "conv_id")
    placed = turns.join(placed, ["part", "conv_id"]).withColumn("pos", F.col("before") + F.col("k"))
    heads = placed.where("conv_id = base and pos <= 5").select("base", "pos", "code", "size")
    heads = heads.join(convs, "base").where("pos <= h").select("conv_id", F.col("pos").alias("at"), "code", "size", "total")
    own = placed.where("pos > h").select("conv_id", (F.col("pos") - F.col("shift")).alias("at"), "code", "size", "total")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("code"), F.lit(0).alias("size"), "total")  # turnless ones are members, too
    tier = F.greatest(F.floor((F.col("at") - 1) / depth), F.lit(0)).cast("int")
    rows = own.union(heads).union(none).groupBy("conv_id", tier.alias("tier")).agg(F.sort_array(F.collect_list(F.struct("at", "code", "size"))).alias("t"), F.max("total").alias("total"))
    given = F.filter("t", lambda x: x["at"] > 0)
    seq = F.unhex(F.array_join(F.transform(given, lambda x: F.hex(x["code"])), ""))
    ends = F.col("tier") == F.greatest(F.floor((F.col("total") - 1) / depth), F.lit(0))
    deepest = convs.agg(F.max("total")).first()[0]
    return rows.select("conv_id", "tier", seq.alias("seq"), F.transform(given, lambda x: x["size"]).alias("sizes"), ends.alias("ends")), deepest


def merged_edges(edges: DataFrame) -> DataFrame:
    """Edges of all shards, one row for each prefix, with the sums of their subtrees."""
    one = edges.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("cls").alias("cls"), F.max("nxt").alias("nxt"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("size").alias("size"),
        F.sum("n_children").alias("off_children"), F.sum("n_leaves").alias("off_leaves"), F.sum("saved").alias("off_saved"), F.max("x_children").alias("x_children"), F.max("x_leaves").alias("x_leaves"), F.max("x_saved").alias("x_saved"),
        F.min(F.struct("part", "path")).alias("start"), F.max(F.struct("part", "path")).alias("stop"),
    )
    one = cut(one)
    kids = one.groupBy(F.col("parent_key").alias("k")).agg(F.count("*").alias("edge_children"))
    one = one.join(kids, F.col("k") == F.col("key"), "left").withColumn("n_children", F.col("off_children") + F.col("x_children") + F.coalesce("edge_children", F.lit(0)))
    one = one.withColumns({"leaves": F.col("off_leaves") + F.col("x_leaves") + (F.col("n_children") == 0).cast("long"), "saves": F.col("off_saved") + F.col("x_saved") + (F.col("n_convs") - 1) * F.col("size")})
    one = one.withColumns({"i": F.col("start.part"), "i_path": F.col("start.path"), "j": F.col("stop.part"), "j_path": F.col("stop.path")})
    above = Window.partitionBy("i").orderBy("i_path", "depth").rowsBetween(Window.unboundedPreceding, -1)  # no more rows than a shard's two paths
    one = cut(one.withColumns({f"above_{x}": F.coalesce(F.sum(x).over(above), F.lit(0)) for x in ("leaves", "saves")}))
    is_new = one.groupBy("i").agg(*[F.sum(x).alias(x) for x in ("leaves", "saves")], *[F.sum(F.when(F.col("i_path") < LAST, F.col(x)).otherwise(0)).alias(f"first_{x}") for x in ("leaves", "saves")])
    totals = edges.select(F.col("part").alias("i")).distinct().join(is_new, "i", "left").na.fill(0)
    shards = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    totals = totals.select("i", *[F.coalesce(F.sum(x).over(shards), F.lit(0)).alias(f"before_{x}") for x in ("leaves", "saves")], *[F.col(x).alias(f"in_{x}") for x in ("leaves", "saves")], "first_leaves", "first_saves")
    totals = cut(totals)
    starts = totals.select("i", *[F.col(f"before_{x}").alias(f"start_{x}") for x in ("leaves", "saves")])
    stops = totals.select(F.col("i").alias("j"), *[(F.col(f"before_{x}") + F.col(f"in_{x}")).alias(f"whole_{x}") for x in ("leaves", "saves")], *[(F.col(f"before_{x}") + F.col(f"first_{x}")).alias(f"part_{x}") for x in ("leaves", "saves")])
    one = one.join(starts, "i").join(stops, "j")
    return one.withColumns({out: F.when(F.col("j_path") == FIRST, F.col(f"part_{x}")).otherwise(F.col(f"whole_{x}")) - F.col(f"start_{x}") - F.col(f"above_{x}") for x, out in (("leaves", "n_leaves"), ("saves", "saved"))})


def tier_nodes(rows: DataFrame, shards: int) -> DataFrame:
    """All nodes of one tier's tries: conv_id, depth, parent_conv_id, cls (of depths 0 and 1), nxt and the contract's sums."""
    keys = ["cls", "seq", "conv_id"]
    found = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    found = cut(found.mapInPandas(build_shards, SHARD_SCHEMA))
    edges = found.where("kind = 'edge'")
    one = cut(merged_edges(edges))
    hashes = found.where("kind = 'ids'").select("key", "part", "chunk", "ends").repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "ends").mapInPandas(hash_in_order, "key binary, ends_sha256 string")
    parents = one.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("p"))
    columns = ["conv_id", "depth", "parent_conv_id", "cls", "nxt", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    of_edges = one.join(parents, "parent_key", "left").join(hashes.withColumnRenamed("ends_sha256", "sha"), "key", "left")
    of_edges = of_edges.withColumns({"parent_conv_id": F.col("p"), "ends_sha256": F.coalesce("sha", F.lit(EMPTY))}).select(columns)
    places = edges.select("part", "path", "depth", "key").join(one.select("key", F.col("conv_id").alias("p")), "key").select("part", F.col("path").alias("parent_path"), (F.col("depth") + 1).alias("depth"), "p")
    others = found.where("kind = 'node'").join(places, ["part", "parent_path", "depth"], "left")
    others = others.withColumns({"parent_conv_id": F.coalesce("p", "parent_conv"), "ends_sha256": F.col("ends")}).select(columns)
    return cut(of_edges.union(others))


def prefix_trie(df: DataFrame, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; by op13's rules of rebuilding."""
    spark = df.sparkSession
    rows, deepest = rebuilt(df, depth)
    tiers = max(1, -(-(deepest or 0) // depth))
    empty = F.lit(b"")
    rows = rows.withColumns({"cls": empty, "nxt": empty})
    if tiers > 1:  # the classes of the turns before and up to each cut
        digest = F.sha2("seq", 256)
        by_tier = Window.partitionBy("conv_id").orderBy("tier")
        seen = {k: F.concat_ws("", F.collect_list(digest).over(by_tier.rowsBetween(Window.unboundedPreceding, to))) for k, to in (("cls", -1), ("nxt", 0))}
        rows = rows.withColumns({k: F.when((F.col("tier") == 0) & F.lit(k == "cls"), empty).otherwise(F.unhex(F.substring(F.sha2(x, 256), 1, 2 * WIDTH))) for k, x in seen.items()})
    rows = cut(rows)
    turns = F.floor(F.length("seq") / WIDTH)
    sizes = {r.tier: r.n for r in rows.groupBy("tier").agg(F.sum(turns + 1).alias("n")).collect()}
    zero = [F.lit(0).cast("long").alias(x) for x in ("x_children", "x_leaves", "x_saved")]
    nodes, roots, extras, alone = [], [], None, None
    if tiers > 1:
        alone = cut(rows.where("tier > 0").groupBy("cls").agg(F.count("*").alias("n")).where("n = 1").select("cls"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for tier in range(tiers - 1, -1, -1):
        here = rows.where(F.col("tier") == tier)
        if tier:  # what only one conversation has is a chain
            single = here.join(alone, "cls").select("conv_id", "cls", "nxt", "ends", F.size("sizes").alias("m"), F.posexplode("sizes").alias("i", "size"))
            last = F.col("i") == F.col("m") - 1
            chain = single.select("conv_id", (F.col("i") + 1 + tier * depth).alias("depth"), F.when(F.col("i") > 0, F.col("conv_id")).alias("parent_conv_id"), F.when(F.col("i") == 0, F.col("cls")).alias("top"),
                                  F.lit(1).cast("long").alias("n_convs"), F.when(last & F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                                  F.when(last & F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
            nodes.append(chain)
            roots.append(single.where(last & ~F.col("ends")).select(F.col("nxt").alias("top"), F.col("conv_id").alias("p")))
            passed = here.join(alone, "cls").select(F.col("cls").alias("nxt"), *[F.lit(x).cast("long").alias(k) for k, x in (("x_children", 1), ("x_leaves", 1), ("x_saved", 0))])
            here = here.join(alone, "cls", "left_anti")
        here = here.select("conv_id", "cls", "seq", "sizes", "ends", "nxt")
        here = here.select("*", *zero) if extras is None else here.join(extras, "nxt", "left").na.fill(0, ["x_children", "x_leaves", "x_saved"])
        found = tier_nodes(here, max(least, 1 + sizes.get(tier, 0) // shard))
        top = F.when(F.col("depth") == 1, F.col("cls")) if tier else F.lit(None).cast("binary")
        parent = F.when(F.col("depth") > 1, F.col("parent_conv_id")) if tier else F.col("parent_conv_id")
        kept = found.where("depth > 0") if tier else found
        nodes.append(kept.select("conv_id", (F.col("depth") + tier * depth).alias("depth"), parent.alias("parent_conv_id"), top.alias("top"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"))
        roots.append(found.where(F.col("nxt").isNotNull()).select(F.col("nxt").alias("top"), F.col("conv_id").alias("p")))
        if tier:
            extras = cut(passed.union(found.where("depth = 0").select(F.col("cls").alias("nxt"), F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved").alias("x_saved"))))
    out, above = nodes[0], roots[0]
    for more in nodes[1:]:
        out = out.union(more)
    for more in roots[1:]:
        above = above.union(more)
    if tiers > 1:
        out = out.join(above, "top", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "p"))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
             lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h FROM ids),
r AS (SELECT c.conv_id, 1 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
      UNION ALL SELECT c.conv_id, 0, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, md5(length(role) || ':' || role || ':' || text) AS code, length(text) AS size FROM r),
p AS (SELECT conv_id, depth, size, string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
n AS (SELECT p.depth, p.key, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.size) AS size, coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE m.last = p.depth), '') AS ends
      FROM p JOIN m ON p.conv_id = m.conv_id GROUP BY p.depth, p.key),
k AS (SELECT depth - 1 AS depth, substr(key, 1, 32 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.key = k.key),
s AS (SELECT p.depth, p.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON f.depth = s.depth AND f.key = s.key LEFT JOIN n q ON q.depth = f.depth - 1 AND q.key = substr(f.key, 1, 32 * (f.depth - 1))
"""
