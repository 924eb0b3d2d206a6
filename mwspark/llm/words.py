"""Vectorised hashing of the words of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that powers can be inverted modulo 2^64
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Breaks words at everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POW: list = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def hash_words(data: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in UTF-8 bytes, A-Z as a-z, and where each begins.

    A word is a longest run of bytes outside breaks: by default 0x20 and 0x09-0x0D.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(_POW[0]) < len(data) + 1:
        _POW[:] = _powers(max(1 << 20, len(data) + 1))
    value = _BYTE[_LOWER[data]]
    value *= _POW[0][: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    h = (total[end] - total[begin]) * _POW[1][begin]
    return mix(h ^ ((end - begin).astype(np.uint64) * _MULT)), begin


def batches(texts: list[bytes], most: int = 1 << 20):
    """(first, last) ranges of texts of about most bytes each."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and len(texts) + 1 bounds into them."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    h, begin = hash_words(data, breaks)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return h, np.searchsorted(begin, starts)
