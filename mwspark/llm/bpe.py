"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes are a doubly linked list. Every adjacent pair that has a merge rank puts its left
position into the bucket of that rank; a bitmap in two levels over the ranks says which buckets hold
anything, so that find-first-set gives the lowest rank in two steps. The leftmost position of that
bucket is merged unless the entry is stale (one of the two nodes has changed since), and the two new
pairs at its sides are queued. A pre-token of n bytes takes at most n merges and 3n queue entries, so a very long one
costs little more than n steps. Pre-tokens of up to TOGETHER bytes that a batch meets for the first time share one queue over
their bytes laid end to end (merge_many): no pair crosses from one to the next, so each is merged in its own order,
and a bucket's leftmost entries of all pre-tokens are merged at once. Each worker keeps what it encoded in a bounded table.

Null and empty texts give no ids and decode to the empty text. Very long texts and pre-tokens, repeated
rows and ties are ordinary. An empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.chunks import ChunkTable
from mwspark.llm.common import bounded_batches, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHE_ENTRIES = 200_000
AT_ONCE = 200_000  # pre-tokens in one queue
CACHE_BYTES = 64  # longer pre-tokens are encoded anew each time
TOGETHER = 256
NONE = 1 << 30  # the rank of a pair that doesn't merge
PACKED = [struct.Struct(f"<{n}I") for n in range(64)]


class Pairs:
    """The ranks of all pairs of ids that merge, in a table with open addressing that is read for many pairs at once."""

    BITS = 19

    def __init__(self, ranks: dict[bytes, int], size: int) -> None:
        self.size, self.mask = size, (1 << self.BITS) - 1
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        get, found = ranks.get, []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                x, y = get(token[:i]), get(token[i:])
                if x is not None and y is not None:
                    found.append((x * (size + 1) + y, rank))
        pair, rank = np.array(found, np.int64).reshape(-1, 2).T
        self.key, self.rank = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, NONE, np.int32)
        left, slot = np.arange(len(pair)), self.slot(pair)
        while len(left):
            empty = left[self.key[slot[left]] < 0]
            self.key[slot[empty]] = pair[empty]  # of those that want one slot, the last stays
            won = self.key[slot[left]] == pair[left]
            self.rank[slot[left[won]]] = rank[left[won]]
            left = left[~won]
            slot[left] = slot[left] + 1 & self.mask

    def slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pair = x.astype(np.int64) * (self.size + 1) + y
        slot = self.slot(pair)
        key = self.key[slot]
        out = np.where(key == pair, self.rank[slot], np.int32(NONE))
        more = np.flatnonzero((key != pair) & (key >= 0))
        while len(more):
            slot[more] = slot[more] + 1 & self.mask
            key = self.key[slot[more]]
            hit = key == pair[more]
            out[more[hit]] = self.rank[slot[more[hit]]]
            more = more[~hit & (key >= 0)]
        return out


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # a pair of ids merges if its bytes together are a token, whose id is the rank: right[x][y].
        # Inside, a token's number is last - id, so that the lowest rank is the highest bit, which bit_length finds
        get, self.last = self.ranks.get, size - 1
        self.right: list[dict[int, int]] = [{} for _ in range(size)]
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                x, y = get(token[:i]), get(token[i:])
                if x is not None and y is not None:
                    self.right[self.last - x][self.last - y] = self.last - rank
        self.pairs = Pairs(self.ranks, size)
        self.bytes = [self.last - self.ranks[bytes([i])] for i in range(256)]
        # the queue is empty again after each pre-token, so one serves all that a worker encodes
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.words = [0] * (size // 256 + 1)  # 256 ranks each; a word over these words is made in merge
        self.bit = [1 << i for i in range(256)]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.cache: dict[str, bytes] = {}
        self.chunks = ChunkTable(self.encode_runs)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        right, buckets, words, bit = self.right, self.buckets, self.words, self.bit
        ids = [self.bytes[x] for x in piece]  # -1: merged into the node before
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        top, x = 0, ids[0]  # top says which words hold a bit
        for i in range(1, n):
            y = ids[i]
            rank = right[x].get(y)
            if rank is not None:
                bucket = buckets[rank]
                if not bucket:
                    a = rank >> 8
                    word = words[a]
                    if not word:
                        top |= bit[a]
                    words[a] = word | bit[rank & 255]
                bucket.append(i - 1)  # these come in order
            x = y
        while top:
            a = top.bit_length() - 1
            word = words[a]
            low = word.bit_length() - 1
            rank = a << 8 | low
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[a] = word = word ^ bit[low]
                if not word:
                    top ^= bit[a]
            x, j = ids[i], after[i]
            if x < 0 or j == n or right[x].get(ids[j]) != rank:
                continue  # stale: a node was merged away or has grown
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = right[rank].get(ids[k])
                if new is not None:
                    bucket = buckets[new]
                    if bucket:
                        heappush(bucket, i)
                    else:
                        bucket.append(i)
                        a = new >> 8
                        word = words[a]
                        if not word:
                            top |= bit[a]
                        words[a] = word | bit[new & 255]
            if i:
                h = before[i]
                new = right[ids[h]].get(rank)
                if new is not None:
                    bucket = buckets[new]
                    if bucket:
                        heappush(bucket, h)
                    else:
                        bucket.append(h)
                        a = new >> 8
                        word = words[a]
                        if not word:
                            top |= bit[a]
                        words[a] = word | bit[new & 255]
        last = self.last
        return [last - x for x in ids if x >= 0]

    def pack(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        return PACKED[len(ids)].pack(*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of many short pre-tokens, by one queue for all."""
        ends = np.cumsum([len(x) for x in pieces])
        n, size = int(ends[-1]), len(self.tokens)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(ends, prepend=0))
        # node n stands for what is beyond a piece's ends: it pairs with nothing
        ids = np.append(self.pairs.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(size))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], after[n] = n, n
        before[np.concatenate([[0], ends[:-1]])] = n
        rank_at = self.pairs.ranks(ids, ids[after])  # of the pair that begins at each node; NONE also once a node is merged away
        buckets: dict[int, list[np.ndarray]] = {}
        words, top = [0] * (size // 256 + 1), 0

        def queue(at: np.ndarray, rank: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for i, r in enumerate(rank[cuts[:-1]].tolist()):
                some = at[cuts[i] : cuts[i + 1]]
                if r in buckets:
                    buckets[r].append(some)
                else:
                    buckets[r] = [some]
                    top |= 1 << (r >> 8)
                    words[r >> 8] |= 1 << (r & 255)

        found = np.flatnonzero(rank_at < NONE)
        if len(found):
            queue(found, rank_at[found])
        while top:
            a = (top & -top).bit_length() - 1
            word = words[a]
            rank = a << 8 | (word & -word).bit_length() - 1
            bucket = buckets.pop(rank)
            at = bucket[0] if len(bucket) == 1 else np.sort(np.concatenate(bucket))
            at = at[rank_at[at] == rank]  # the others are stale
            own = piece[at]
            first = np.concatenate([[True], own[1:] != own[:-1]])[: len(at)]
            if first.all():
                words[a] = word & (word - 1)
                if not words[a]:
                    top &= top - 1
            else:  # each piece's leftmost now; a merge may make a pair of lower rank before its next
                buckets[rank] = [at[~first]]
                at = at[first]
            if not len(at):
                continue
            gone = after[at]
            beyond, prior = after[gone], before[at]
            ids[at], ids[gone], rank_at[gone] = rank, -1, NONE
            after[at], before[beyond] = beyond, at
            pair = np.concatenate([at, prior])
            new = self.pairs.ranks(ids[pair], ids[np.concatenate([beyond, at])])
            rank_at[pair] = new
            good = new < NONE
            if good.any():
                queue(pair[good], new[good])
        kept = ids[:-1] >= 0
        packed, bounds = ids[:-1][kept].astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(piece[kept], minlength=len(pieces)))
        return [packed[i:j] for i, j in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True)]

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Packed ids of each run; pre-tokens that are new here are merged together."""
        split, cache = [self.split(r) for r in runs], self.cache
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        new = list({w for words in split for w in words}.difference(cache))
        raw = [w.encode() for w in new]
        own: dict[str, bytes] = {}
        short = []
        for w, x in zip(new, raw, strict=True):
            whole = self.ranks.get(x)
            if whole is not None:
                own[w] = PACKED[1].pack(whole)
            elif len(x) <= TOGETHER:
                short.append((w, x))
            else:
                own[w] = self.pack(w)
        for k in range(0, len(short), AT_ONCE):
            some = short[k : k + AT_ONCE]
            own.update(zip([w for w, _ in some], self.merge_many([x for _, x in some]), strict=True))
        out = [b"".join([cache.get(w) or own[w] for w in words]) for words in split]
        for w, x in own.items():
            if len(cache) >= CACHE_ENTRIES:
                break
            if len(w) <= CACHE_BYTES:
                cache[w] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.chunks.encode(texts)

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def encode(text, path: str = RANKS):
    """Column of ids (binary, little-endian unsigned 32-bit) of a text column."""

    @F.pandas_udf("binary")
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series(codec(path).encode([t or "" for t in s]), dtype=object)

    return ids(text)


def decode(ids, path: str = RANKS):
    """Column of the bytes (binary) that ids stand for."""

    @F.pandas_udf("binary")
    def back(s: pd.Series) -> pd.Series:
        return pd.Series([codec(path).decode(x) for x in s], dtype=object)

    return back(ids)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 4000, "12m")
    docs = table(spark, sf_dir, "documents").select("doc_id", encode(F.col("text")).alias("ids"))
    docs = docs.withColumn("decoded", decode(F.col("ids")))
    return docs.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
