"""Encodes texts in the chunks between single spaces, each distinct chunk once.

The split pattern of the byte-level vocabularies always has a boundary before a space that stands between
two characters other than white space. A chunk that is empty or begins or ends with white space is taken
together with its neighbours, so every piece that is encoded alone would be split alike inside its text.
"""

from __future__ import annotations

from collections.abc import Callable

LONGEST = 64  # longer chunks aren't kept
AT_ONCE = 1 << 22  # characters


class ChunkTable:
    """Ids (bytes) of the chunks met so far, at most entries of them; one for each worker process."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], entries: int = 700_000) -> None:
        self.encode_all, self.entries = encode_all, entries
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, joined; a few at a time, since a text in parts takes ten times its memory."""
        out, some, held = [], [], 0
        for text in texts:
            some.append(text)
            held += len(text)
            if held >= AT_ONCE:
                out += self.encode_some(some)
                some, held = [], 0
        return out + self.encode_some(some)

    def encode_some(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.entries:
            self.known.clear()
        known, plans, todo = self.known, [], {}
        for text in texts:
            first, *parts = text.split(" ")
            new = set(parts).difference(known)  # known.keys() would be walked whole
            if (first and first[-1].isspace()) or not first or not all([p and not p[0].isspace() and not p[-1].isspace() for p in new]):
                runs = together(first, parts)
                todo.update(dict.fromkeys(runs))
                plans.append((runs, None))
            else:
                todo.update(dict.fromkeys(" " + p for p in new))
                todo[first] = None
                plans.append(([first], parts))
        runs = list(todo)
        ids = dict(zip(runs, self.encode_all(runs), strict=True))
        fresh = {}
        for run, x in ids.items():
            if run[:1] == " " and is_plain(run[1:]):
                (known if len(run) <= LONGEST else fresh)[run[1:]] = x
        out = []
        for head, parts in plans:
            got = [ids[r] for r in head]
            if parts:
                got += map(known.get, parts) if not fresh else [known.get(p) or fresh[p] for p in parts]
            out.append(b"".join(got))
        return out


def is_plain(part: str) -> bool:
    return bool(part) and not part[0].isspace() and not part[-1].isspace() and " " not in part


def together(first: str, parts: list[str]) -> list[str]:
    """The text cut before each single space that has no white space beside it."""
    out, run = [], first
    for p in parts:
        if not p or p[0].isspace() or not run or run[-1].isspace():
            run += " " + p
        else:
            out.append(run)
            run = " " + p
    return [*out, run]
