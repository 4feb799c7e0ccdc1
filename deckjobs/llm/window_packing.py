"""Packing of token ids into windows by best-fit decreasing.

A document's ids, with an end id, are first cut into full windows; each of these is a
sequence of its own. What is left of each document goes, longest first, into the open window
that it fills best: a segment tree over the remaining capacities gives the least one that is
enough. Windows that stay loose are then taken apart, and their pieces cut, to fill the gaps
of fuller ones, so that a crowd of like lengths (copies of one document) packs as well as a
mixture. The one loose window that is left of a block of documents goes into the next block;
the last of a task is cut at powers of two, which are lengths of their own and not padded.

Every task packs the documents that it reads: no shuffle, no key that could be hot, and no
more than a block of rests in memory. Sequences do not cross tasks; their ids hold the
partition and a count, so they are unique and, for the same input files, the same each time.
A row of the result is a piece; ``sequences`` joins pieces into padded rows.

Defined results: a null or empty text is the end id alone; a null doc_id is kept; repeated
rows are packed as documents of their own; an empty table gives no pieces; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, text_bytes
from .token_store import parts_of, word_coder

WINDOW = 2048
END_ID = 1
#: Rests of documents that are packed together.
BLOCK = 1 << 13
#: A window with a gap of so few tokens counts as full.
SLACK = 16
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: (document, first id there, number of ids)
Piece = tuple[int, int, int]


class OpenWindows:
    """Windows by remaining capacity, in a segment tree that knows where any is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, window: int, room: int) -> None:
        self.at[room].append(window)
        i = room + self.leaves
        while i:
            self.some[i] += 1
            i >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """An open window of the least room that holds ``size``, taken out, and its room."""
        i = size + self.leaves
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.some[i] -= 1
            i >>= 1
        return self.at[room].pop(), room


def best_fit(pieces: Iterable[Piece], capacity: int = WINDOW) -> list[list[Piece]]:
    """Pieces of at most ``capacity``, longest first, each into the window that it fills best."""
    windows: list[list[Piece]] = []
    tree = OpenWindows(capacity)
    for piece in sorted(pieces, key=lambda p: -p[2]):
        found = tree.tightest(piece[2])
        if found is None:
            at, room = len(windows), capacity
            windows.append([])
        else:
            at, room = found
        windows[at].append(piece)
        if room > piece[2]:
            tree.add(at, room - piece[2])
    return windows


def filled(window: list[Piece]) -> int:
    return sum(p[2] for p in window)


def tightened(windows: list[list[Piece]], capacity: int = WINDOW, slack: int = SLACK) -> tuple[list[list[Piece]], list[Piece]]:
    """(windows with gaps of at most ``slack``, pieces of the one that stays loose).

    The loosest windows give their pieces, cut where need be, to the gaps of the fullest.
    """
    by_room = sorted((list(w) for w in windows), key=filled, reverse=True)
    into, out_of = 0, len(by_room) - 1
    while into < out_of:
        gap = capacity - filled(by_room[into])
        if gap <= slack:
            into += 1
        elif not by_room[out_of]:
            out_of -= 1
        else:
            doc, first, n = by_room[out_of].pop()
            part = min(gap, n)
            by_room[into].append((doc, first + n - part, part))
            if n > part:
                by_room[out_of].append((doc, first, n - part))
    done = [w for w in by_room if w and capacity - filled(w) <= slack]
    return done, [p for w in by_room if capacity - filled(w) > slack for p in w]


def power_cuts(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces cut into sequences whose lengths are the binary digits of their sum, greatest first."""
    out: list[list[Piece]] = []
    left = filled(pieces)
    rest = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, first, n = rest.pop()
            part = min(room, n)
            out[-1].append((doc, first, part))
            room -= part
            if n > part:
                rest.append((doc, first + part, n - part))
    return out


class Packer:
    """Packs the documents of one task; gives pieces with their ids as soon as a sequence is closed."""

    def __init__(self, partition: int, capacity: int = WINDOW, block: int = BLOCK, slack: int = SLACK):
        self.capacity, self.block, self.slack = capacity, block, slack
        self.next_id = partition << 40
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []  # doc_id, ids of the rest, where it begins, ids in all
        self.pieces: list[Piece] = []

    def _sequence(self, window: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for doc, first, n in window:
            name, ids, begins, total = self.docs[doc]
            yield name, begins + first, n, ids[first : first + n].tobytes(), total, self.next_id, offset
            offset += n
        self.next_id += 1

    def add(self, name: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Full windows at once; the rest is held."""
        whole = len(ids) // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            yield name, a, self.capacity, ids[a : a + self.capacity].tobytes(), len(ids), self.next_id, 0
            self.next_id += 1
        if len(ids) > whole:
            self.pieces.append((len(self.docs), 0, len(ids) - whole))
            self.docs.append((name, ids[whole:].copy(), whole, len(ids)))
            if len(self.pieces) >= self.block:
                yield from self.flush(False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        done, loose = tightened(best_fit(self.pieces, self.capacity), self.capacity, self.slack)
        for window in done:
            yield from self._sequence(window)
        if last:
            for window in power_cuts(loose):
                yield from self._sequence(window)
            loose = []
        of = sorted({p[0] for p in loose})
        self.docs, at = [self.docs[i] for i in of], {i: k for k, i in enumerate(of)}
        self.pieces = [(at[i], first, n) for i, first, n in loose]


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, block: int = BLOCK, slack: int = SLACK) -> DataFrame:
    """docs(doc_id, text) -> pieces: doc_id, start, length, ids (little-endian 32 bit), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), window, block, slack)
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), list(text_bytes(batch["text"]))
            for a, b in pieces_of(texts, 1 << 21):
                parts, doc = parts_of(texts[a:b])
                ids, n = coder.ids(parts)
                ends = np.cumsum(np.bincount(doc, n, b - a).astype(np.int64))
                every = np.insert(ids.astype("<u4"), ends, end_id)
                ends += np.arange(1, b - a + 1)
                first = 0
                for name, end in zip(names[a:b], ends.tolist(), strict=True):
                    rows.extend(packer.add(name, every[first:end]))
                    first = end
                if len(rows) > 2000:
                    yield batch_of()
        rows.extend(packer.flush())
        if rows:
            yield batch_of()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def padding(fill: Column, window: int = WINDOW) -> Column:
    """Ids that a sequence of ``fill`` ids is padded with: up to the window, none at a power of two."""
    return F.when(fill.bitwiseAND(fill - 1) == 0, 0).otherwise(window - fill)


def sequences(pieces: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """sequence_id, doc_ids, lengths (both by offset), ids padded by the rule above, n_padded."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    x = pieces.groupBy("sequence_id").agg(rows.alias("p"), F.sum("length").alias("fill"))
    n = padding(F.col("fill"), window).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), n))
    ids = F.unhex(F.concat(F.array_join(F.transform("p", lambda r: F.hex(r["ids"])), ""), F.hex(pad)))
    return x.select("sequence_id", F.transform("p", lambda r: r["doc_id"]).alias("doc_ids"), F.transform("p", lambda r: r["length"]).alias("lengths"), ids.alias("ids"), n.alias("n_padded"))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the unsigned crc32 of their ids instead of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
