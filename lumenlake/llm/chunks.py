"""A bounded table from distinct text chunks to their token ids."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Hashable, Iterable


class ChunkTable:
    """Encodes each distinct chunk once and keeps its ids as little-endian 32-bit bytes.

    ``encode`` gets the list of chunks that are not known yet. There are two generations: once the
    young one holds ``limit`` chunks it becomes the old one, and what is used again moves on. So
    frequent chunks stay and memory is bounded whatever the corpus. Chunks longer than ``longest``
    are encoded each time and never kept.

    ``marks`` is a set or dict in which ``encode`` notes some chunks. Once it holds over ``limit`` it
    is cleared with both generations, before a call reads either, so that each chunk that is met
    again is encoded and noted again.
    """

    def __init__(self, encode: Callable[[list], list[bytes]], limit: int = 50_000, longest: int = 200, marks: set | dict | None = None):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.marks = set() if marks is None else marks
        self.young: dict[Hashable, bytes] = {}
        self.old: dict[Hashable, bytes] = {}

    def ids(self, documents: list[list]) -> list[bytes]:
        """For each document, given as its chunks in order, the joined ids."""
        distinct: set = set()
        for chunks in documents:
            distinct.update(chunks)
        if len(self.marks) > self.limit:
            self.marks.clear()
            self.young, self.old = {}, {}
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        distinct.difference_update(known)
        new = []
        for c in distinct:
            if (ids := old.get(c)) is None:
                new.append(c)
            else:
                known[c] = ids
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        out = [b"".join([known[c] for c in chunks]) for chunks in documents]
        for c in new:
            if len(c) > self.longest:
                del known[c]
        return out


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()
