"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps at most OPEN_WINDOWS open windows. A document's whole windows leave at once; what is
left of it goes to the open window where it fits best, and if none has room, the fullest is emitted and a
new one opened. The windows still open at the end are merged: those of MERGED partitions at a time are put
one after another and cut anew, so that only the last window of such a group stays short.

A null text is an empty one; every document ends with END, so none is without ids. Very long texts
make many pieces; repeated rows are packed as often as they occur, with the same doc_id; null ids are kept. An empty table gives no
rows. Only the id and text columns are read. Sequence numbers follow the order in which the table's files
are read; a task that runs again gives the same ones.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.common import bounded_batches, cut, release_memory, table

WINDOW = 2048
OPEN_WINDOWS = 64
MERGED = 16
END = 1
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The ids of a text under a byte-level vocabulary file of `tokenizers`; one for each worker process.

    The file's vocabulary is run by the `tiktoken` library, which takes a quarter of the time. Both give the
    same ids when each token of the file, encoded alone by its merges, is itself (a test checks that for all):
    then a pair of nodes whose bytes make up a token is always the pair of that token's own merge. The file's
    added tokens are matched in the text first, as `tokenizers` does by default.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    value = byte_values()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take part of their surroundings are not supported")
    ranks = {bytes(value[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


LONG_RUN = 50_000
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # what the split pattern takes for white space
LONG_RUNS = re.compile(SPACE + f"{{{LONG_RUN},}}")


def ids_of(text: str, path: str) -> bytes:
    """The ids of a whole text.

    The split pattern backs up over a run of white space, for which the library has bounded room. A run is one piece but for its last
    character, which goes with what follows; so a very long one is taken out and merged by itself.
    """
    if not text:
        return b""
    encode = tokenizer(path)
    if len(text) < LONG_RUN:
        return encode.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
    out, at = [], 0
    for run in LONG_RUNS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out.append(encode.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        out.append(np.array(encode._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    out.append(encode.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out).astype("<u4").tobytes()


class Packer:
    """The open windows of one partition. A piece is [doc_id, start, ids (bytes), doc_tokens]."""

    def __init__(self, first_sequence: int, window: int, open_windows: int) -> None:
        self.next, self.window, self.most = first_sequence, window, open_windows
        self.free: list[int] = []
        self.held: list[list] = []

    def add(self, doc_id: int, ids: bytes) -> Iterator[tuple]:
        """Takes one document; gives the pieces of windows that are complete."""
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            yield from self.emit([[doc_id, at, ids[4 * at : 4 * (at + self.window)], total]])
            at += self.window
        size = total - at
        if not size:
            return
        best = min((i for i, f in enumerate(self.free) if f >= size), key=self.free.__getitem__, default=None)
        if best is None:
            if len(self.free) >= self.most:
                yield from self.close(min(range(len(self.free)), key=self.free.__getitem__))
            best = len(self.free)
            self.free.append(self.window)
            self.held.append([])
        self.free[best] -= size
        self.held[best].append([doc_id, at, ids[4 * at :], total])
        if not self.free[best]:
            yield from self.close(best)

    def close(self, i: int) -> Iterator[tuple]:
        self.free.pop(i)
        yield from self.emit(self.held.pop(i))

    def emit(self, pieces: list[list], still_open: bool = False) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, self.next, offset, ids, still_open
            offset += n
        self.next += 1

    def rest(self) -> Iterator[tuple]:
        while self.held:
            self.free.pop()
            yield from self.emit(self.held.pop(), True)


def frame(rows: list[tuple], keep_ids: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=NAMES)
    out["doc_id"] = out["doc_id"].astype("Int64")
    if not keep_ids:
        out["ids"] = [x if o else None for x, o in zip(out["ids"], out["open"], strict=True)]
    return out


def merge(pdf: pd.DataFrame, window: int, keep_ids: bool) -> pd.DataFrame:
    """Puts the open windows of a group one after another and cuts them into full ones; the last stays short."""
    pdf = pdf.sort_values(["sequence_id", "offset"])
    packer, held, free = Packer(int(pdf.sequence_id.min()), window, 1), [], window
    rows: list[tuple] = []
    for doc_id, start, ids, total in zip(pdf.doc_id, pdf.start, pdf.ids, pdf.doc_tokens, strict=True):
        while ids:
            part, ids = ids[: 4 * free], ids[4 * free :]
            held.append([doc_id, start, part, total])
            start, free = start + len(part) // 4, free - len(part) // 4
            if not free:
                rows += packer.emit(held)
                held, free = [], window
    if held:
        rows += packer.emit(held)
    out = frame(rows, True)
    if not keep_ids:
        out["ids"] = None
    return out


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end: int = END, vocabulary: str = VOCABULARY, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids for each piece.

    ids are little-endian unsigned 32-bit numbers; with keep_ids=False they are null (their CRC-32 is there
    in any case) and the table that is written on the way holds none but those of open windows.
    """
    bounded_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows)
        for pdf in frames:
            names = [None if pd.isna(d) else int(d) for d in pdf.doc_id]
            yield frame([r for d, t in zip(names, pdf.text, strict=True) for r in packer.add(d, ids_of(t or "", vocabulary) + tail)], keep_ids)
        yield frame(list(packer.rest()), keep_ids)

    pieces = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECE))
    group = F.shiftright("sequence_id", 32 + (MERGED.bit_length() - 1)).alias("group")
    merged = pieces.where("open").groupBy(group).applyInPandas(lambda pdf: merge(pdf, window, keep_ids), PIECE)
    return pieces.where("not open").union(merged).drop("open")


def op2_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
