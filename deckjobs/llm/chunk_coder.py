"""Token ids of text chunks that are coded independently of each other, each distinct chunk once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Distinct chunks that one Python worker remembers; later ones are coded once for each call.
REMEMBERED = 600_000


def binary_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of every pair (none empty, none overlapping, in order) as one Arrow array."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])


def gathered(pool: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[first:first+length] of every pair, one after the other."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    before = np.cumsum(length) - length
    return pool[np.repeat(first - before, length) + np.arange(total)]


class ChunkCoder:
    """``code(list of chunks) -> list of id lists`` behind a bounded memory of chunks."""

    def __init__(self, code: Callable[[list[bytes]], list], limit: int = REMEMBERED):
        self.code, self.limit = code, limit
        self.slot: dict[bytes, int] = {}
        self.first = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.int32)
        self.used = 0

    def _add(self, chunks: list[bytes]) -> None:
        coded = self.code(chunks)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        n, m = len(self.slot), len(chunks)
        if n + m > len(self.first):
            self.first = np.resize(self.first, max(2 * len(self.first), n + m))
            self.length = np.resize(self.length, len(self.first))
        total = int(lengths.sum())
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + total))
        self.first[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.pool[self.used : self.used + total] = np.fromiter((x for ids in coded for x in ids), np.int32, total)
        self.used += total
        self.slot.update(zip(chunks, range(n, n + m), strict=True))

    def ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each chunk."""
        if not len(chunks):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.slot]
        before, used = len(self.slot), self.used
        if new:
            self._add(new)
        slots = np.fromiter((self.slot[c] for c in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        length = self.length[slots]
        out = gathered(self.pool, self.first[slots], length)
        if before >= self.limit:
            for c in new:
                del self.slot[c]
            self.used = used
        return out, length
