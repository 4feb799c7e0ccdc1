"""Removal of long byte strings that an earlier document also has, by merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a document
with a smaller id. All strings of that length in all documents take part:

1. Every string of 50 bytes has a key, the least hash of its 16-byte substrings; equal
   strings have equal keys, wherever they are. Consecutive strings with the same key form a
   run. Tasks send each key of their documents once, packed, to find the keys that occur in
   two documents; these become a bit set of bounded size. It may let further keys through,
   never lose one.
2. Runs with such keys are cut out (the text under the run is a segment) and equal segments
   are reduced to one, with the least and greatest id.
3. Distinct segments meet by key. In a task they are taken in shards; the suffixes of each
   shard that begin at a key's substring are sorted once. The sorted shards are merged, and
   the order of all suffixes that begin further left follows by interleave refinement:
   dealing every suffix's preceding symbol (the Burrows-Wheeler column) in order gives the
   order of the suffixes one symbol longer. Common prefixes of the merged order and the
   blocks of the refinement give the intervals of strings that repeat, and the least id in
   an interval is where they start first. No suffix is sorted again.
4. Each run takes the result of its segment; the bytes to go are joined to their document.

A key with more than ``crowd`` distinct segments is not held in one task: its segments are
split into their single strings, whose least ids are a plain aggregate.

Defined results: null counts as empty; texts under 50 bytes keep all; documents of equal id
do not take from each other (repeated rows are treated alike); a null id sorts last; an
empty table gives an empty result; other columns are not read unless named in ``columns``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, keep, lean, mixed, pieces_of, shuffle_width, text_bytes

LENGTH = 50
GRAM = 16
#: Suffixes of a shard, and symbols of all shards that are merged at once.
SHARD, MERGED = 1 << 14, 1 << 22
#: Places that are hashed at once.
STRETCH = 1 << 16
#: Distinct segments of one key that a task holds.
CROWD = 20_000
#: Most bits of the set of shared keys: 64 MB.
MOST_BITS = 29
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def gram_hash(eight: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at every place, from the 8 bytes at every place."""
    h = eight[:-8] * _C1 + eight[8:] * _C2
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    return h


def key_runs(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, first start, number of starts, key) of all runs of strings with one key."""
    for a, b in pieces_of(texts, 1 << 17):
        size = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        joined = b"".join(texts[a:b])
        n = len(joined)
        if n < length:
            continue
        eight = np.ndarray((n - 7,), "<u8", joined, strides=(1,))
        least = _sliding_min(gram_hash(eight), length - GRAM + 1)
        begin = np.cumsum(size) - size
        room = np.maximum(size - length + 1, 0)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, begin[room > 0], 1)
        np.add.at(edge, (begin + room)[room > 0], -1)
        valid = np.cumsum(edge)[: len(least)] > 0
        first = valid.copy()
        first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        first[begin[room > 0]] = True
        start = np.flatnonzero(first)
        if not len(start):
            continue
        doc = np.searchsorted(begin, start, "right") - 1
        doc_stop = (begin + room)[doc]
        stop = np.minimum(np.append(start[1:], n), doc_stop)
        yield doc + a, start - begin[doc], stop - start, mixed(least[start])


def _slices(spark) -> int:
    return max(16, 1 << (2 * shuffle_width(spark) - 1).bit_length())


def _key_blobs(slices: int, length: int):
    """Keys of a task's documents, each once with its document (-1: several), packed by slice of the key space."""
    bits = slices.bit_length() - 1

    def reduced(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.append(True, keys[1:] != keys[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(keys)) - 1
        return keys[at], np.where(docs[at] == docs[last], docs[at], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, docs = reduced(np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held]))
            cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(slices + 1, dtype=np.uint64))
            rest = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            rows = [(s, rest[i:j].tobytes(), docs[i:j].tobytes()) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["slice", "keys", "docs"])

        for batch in batches:
            ids = batch["id"].to_numpy()
            for doc, _, _, key in key_runs(list(text_bytes(batch["text"])), length):
                held.append((key, ids[doc]))
                size += len(key)
                if size > 1_500_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def shared_keys(docs: DataFrame, length: int = LENGTH) -> tuple[np.ndarray, int]:
    """The bit set of keys that two documents of docs(id, text) have, and its number of bits (a power).

    It has about one bit for eight bytes of text, up to ``MOST_BITS``; beyond that more
    keys pass by chance, which costs work and changes no result.
    """
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = _slices(spark)
    low = slices.bit_length() - 1
    bits = min(max((int(n) // 8).bit_length(), low + 10), max(MOST_BITS, low + 3))

    def marked(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        several = (np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)) | (np.minimum.reduceat(ids, at) == -1)
        on = np.zeros(1 << (bits - low), bool)
        on[keys[at][several] >> np.uint32(32 - (bits - low))] = True
        return pa.table({"slice": [table["slice"][0].as_py()], "on": [np.packbits(on).tobytes()]}, pa.schema([("slice", pa.int32()), ("on", pa.binary())]))

    blobs = docs.select("id", "text").mapInArrow(lean(_key_blobs(slices, length)), "slice int, keys binary, docs binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (bits - low - 3)
    for r in blobs.groupBy("slice").applyInArrow(marked, "slice int, on binary").toLocalIterator():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["on"], np.uint8)
    return out, bits


def segment_id(segment: bytes) -> bytes:
    return xxhash.xxh3_128_digest(segment)


_WORD = 1 << 15


def known_segments(known: DataFrame) -> tuple[np.ndarray, int]:
    """The bit set of the segment ids in ``known``, of about 16 bits each up to ``MOST_BITS``; never loses one."""
    n = known.count()
    bits = min(max((16 * n).bit_length(), 16), MOST_BITS)
    place = F.shiftrightunsigned(F.xxhash64("segment_id"), 64 - bits)
    words = known.groupBy(F.shiftright(place, 15).alias("word")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(_WORD - 1))).alias("on"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in words.toLocalIterator():
        out[r["word"] * (_WORD // 8) : (r["word"] + 1) * (_WORD // 8)] = np.frombuffer(r["on"], np.uint8)
    return out, bits


def _occurrences(shared, bits: int, length: int, whole: bool, wanted=None, wanted_bits: int = 0):
    """Runs whose key is in the set: each segment of the task once, or the runs of wanted segments with document and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = shared.value
        held: dict[bytes, tuple[int, int, int]] = {}

        def flushed() -> pa.RecordBatch:
            keys, low, high = zip(*held.values(), strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(held), pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["key", "segment", "low", "high"])
            held.clear()
            return out

        for batch in batches:
            texts, ids = list(text_bytes(batch["text"])), batch["id"].to_numpy()
            tags: dict[int, int] = {}
            for doc, start, count, key in key_runs(texts, length):
                slot = (key >> np.uint64(64 - bits)).astype(np.int64)
                some = np.flatnonzero((on[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
                if not len(some):
                    continue
                doc, start, count, key = doc[some], start[some], count[some], key[some]
                cut = [texts[d][s : s + c + length - 1] for d, s, c in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True)]
                if whole:
                    for k, x, i in zip(key.view(np.int64).tolist(), cut, ids[doc].tolist(), strict=True):
                        old = held.get(x)
                        held[x] = (k, i, i) if old is None else (k, min(old[1], i), max(old[2], i))
                    if len(held) > 200_000:
                        yield flushed()
                else:
                    names = [segment_id(x) for x in cut]
                    slot = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in names), np.uint64, len(names)) >> np.uint64(64 - wanted_bits)
                    slot = slot.astype(np.int64)
                    some = np.flatnonzero((wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    if not len(some):
                        continue
                    doc, start, names = doc[some], start[some], [names[i] for i in some.tolist()]
                    for d in np.unique(doc).tolist():
                        if d not in tags:
                            tags[d] = int(np.uint64(xxhash.xxh64_intdigest(texts[d], 42)).astype(np.int64))
                    tag = np.fromiter((tags[d] for d in doc.tolist()), np.int64, len(doc))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids[doc]), pa.array(tag), pa.array(start.astype(np.int32))], ["segment_id", "id", "tag", "start"])
        if held:
            yield flushed()

    return run


def sorted_shard(anchored: np.ndarray) -> np.ndarray:
    """Order of a shard's anchored suffixes (rows of ``LENGTH`` bytes); sorted here once."""
    return np.argsort(anchored, kind="stable")


def merged_order(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Joint order of sorted shards (their rows one after the other), and common prefixes of neighbours.

    The stable sort finds the sorted shards as runs and only merges them.
    """
    rows = np.concatenate(shards)
    order = np.argsort(rows, kind="stable")
    symbols = rows.view(np.uint8).reshape(len(rows), -1)
    common = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), SHARD):
        some = symbols[order[a - 1 : a + SHARD]]
        differ = some[1:] != some[:-1]
        common[a : a + SHARD] = np.where(differ.any(1), differ.argmax(1), symbols.shape[1])
    return order, common


def refined(order: np.ndarray, block: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of interleave refinement: the order and blocks of the suffixes one symbol longer to the left.

    ``order`` lists the suffixes, those of one block in a row; ``symbols`` are what stands
    before each in that order (the transform). Dealing them by symbol, in order, sorts the
    longer suffixes; they stay in one block if both symbol and block were the same. What
    is left alone in its block repeats nowhere and goes.
    """
    deal = np.argsort(symbols, kind="stable")
    order, block, symbols = order[deal], block[deal], symbols[deal]
    new = np.append(True, (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1]))
    return without_single(order, new)


def without_single(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their block with another, and their blocks; ``new`` marks where blocks begin."""
    alone = new & np.append(new[1:], True)
    return order[~alone], np.cumsum(new, dtype=np.int32)[~alone]


def _anchors(joined: bytes, size: np.ndarray, begin: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``joined`` of every gram that has its segment's key, that segment, and the place in it.

    Places are looked at in stretches, so that no array is as long as all segments.
    """
    found = []
    for a in range(0, len(joined) - length, STRETCH):
        b = min(a + STRETCH, len(joined) - length)
        eight = np.ndarray((b - a + 8,), "<u8", joined, offset=a, strides=(1,))
        where = np.arange(a, b)
        owner = np.searchsorted(begin, where, "right") - 1
        at = np.flatnonzero((mixed(gram_hash(eight)) == keys[owner]) & (where - begin[owner] + GRAM <= size[owner]))
        found.append((at + a, owner[at], at + a - begin[owner[at]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def first_ids(segments: list[bytes], keys: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every string of ``length`` bytes in each segment, the least id of a segment that has it.

    Equal strings hold the gram of their key at the same place, so suffixes are anchored
    there: sorted once by shard from the anchor on, merged, then extended to the left by
    refinement. A string that begins i symbols before its anchor is the interval of the
    order by the first ``length`` - i symbols after i steps.
    """
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.cumsum(size) - size
    joined = b"".join(segments) + bytes(length)
    text = np.frombuffer(joined, np.uint8)
    at, seg, place = _anchors(joined, size, begin, keys, length)
    starts = size[seg] - length + 1
    before = np.where(np.append(False, seg[1:] == seg[:-1]), np.append(0, place[:-1]) + 1, 0)
    far = np.minimum(place - before, length - GRAM)
    near = np.maximum(place - (starts - 1), 0)
    some = far >= near
    at, seg, place, far, near = at[some], seg[some], place[some], far[some], near[some]
    windows = np.ndarray((len(text) - length + 1,), f"S{length}", joined, strides=(1,))
    shards, orders = [], []
    for a in range(0, len(at), SHARD):
        rows = windows[at[a : a + SHARD]]
        order = sorted_shard(rows)
        shards.append(rows[order])
        orders.append(order + a)
    room = np.maximum(size - length + 1, 0)
    flat, flat_begin = np.repeat(ids, room), np.cumsum(room) - room
    if not shards:
        return np.split(flat, flat_begin[1:])
    joint, common = merged_order(shards)
    joint = np.concatenate(orders)[joint]
    # a suffix near the end of its segment goes on in the next one: too short for any deeper order
    for i in range(length - GRAM + 1):
        new = common < length - i
        use = (far[joint] >= i) & (near[joint] <= i)
        block = np.cumsum(new, dtype=np.int32)[use]
        order, block = without_single(joint[use], np.append(True, block[1:] != block[:-1])) if len(block) else (joint[:0], block)
        for t in range(1, i + 1):
            if not len(order):
                break
            order, block = refined(order, block, text[at[order] - t])
        if len(order):
            begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            least = np.minimum.reduceat(ids[seg[order]], begins)
            flat[flat_begin[seg[order]] + place[order] - i] = np.repeat(least, np.diff(np.append(begins, len(order))))
    return np.split(flat, flat_begin[1:])


def _runs_of(first: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    at = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    return at.tolist(), np.append(at[1:], len(first)).tolist(), first[at].tolist()


def _solved(length: int, crowd: int):
    """Segments in order of key -> what is first where, for segments with a string that some other document has before."""
    names = ["segment_id", "froms", "tos", "firsts", "segment", "id", "last"]
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        batch_segments: list[bytes] = []
        batch_keys: list[int] = []
        batch_ids: list[int] = []
        batch_last: list[int] = []
        size = 0
        group: list[tuple[bytes, int, int]] = []
        group_key, crowded = None, False

        def close() -> None:
            nonlocal size, group, crowded
            if crowded:
                out.extend((None, None, None, None, *x) for x in group)
            elif len(group) == 1:
                segment, low, high = group[0]
                if high > low:
                    out.append((segment_id(segment), [0], [len(segment) - length + 1], [low], None, None, None))
            else:
                for segment, low, high in group:
                    batch_segments.append(segment)
                    batch_keys.append(group_key)
                    batch_ids.append(low)
                    batch_last.append(high)
                    size += len(segment) + 1
            group, crowded = [], False

        def solve() -> None:
            nonlocal size
            if batch_segments:
                for segment, last, first in zip(batch_segments, batch_last, first_ids(batch_segments, np.array(batch_keys, np.int64).view(np.uint64), np.array(batch_ids, np.int64), length), strict=True):
                    if (first < last).any():
                        out.append((segment_id(segment), *_runs_of(first), None, None, None))
            batch_segments.clear()
            batch_keys.clear()
            batch_ids.clear()
            batch_last.clear()
            size = 0

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for key, segment, low, high in zip(batch["key"].to_pylist(), batch["segment"].to_pylist(), batch["low"].to_pylist(), batch["high"].to_pylist(), strict=True):
                if key != group_key:
                    close()
                    group_key = key
                    if size > MERGED:
                        solve()
                group.append((segment, low, high))
                if len(group) > crowd:
                    crowded = True
                    out.extend((None, None, None, None, *x) for x in group)
                    group = []
                if len(out) > 20_000:
                    yield emit()
        close()
        solve()
        if out:
            yield emit()

    return run


def _single_strings(length: int):
    """The strings of crowded segments, one a row, with the segment they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, low, high in zip(batch["segment"].to_pylist(), batch["id"].to_pylist(), batch["last"].to_pylist(), strict=True):
                n = len(segment) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([segment_id(segment)] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([segment[i : i + length] for i in range(n)], pa.binary()), pa.array([low] * n, pa.int64()), pa.array([high] * n, pa.int64())], ["segment_id", "at", "string", "id", "last"])

    return run


def first_occurrences(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """docs(id, text) -> (id, tag, froms, tos, start): for a run at ``start`` of the document, what of it starts earlier elsewhere."""
    spark = docs.sparkSession
    on, bits = shared_keys(docs, length)
    shared = spark.sparkContext.broadcast(on)
    segments = docs.select("id", "text").mapInArrow(lean(_occurrences(shared, bits, length, True)), "key long, segment binary, low long, high long")
    by_key = segments.repartition(4 * shuffle_width(spark), "key")
    by_key = by_key.groupBy("key", "segment").agg(F.min("low").alias("low"), F.max("high").alias("high")).sortWithinPartitions("key")
    solved = by_key.mapInArrow(lean(_solved(length, crowd)), "segment_id binary, froms array<int>, tos array<int>, firsts array<long>, segment binary, id long, last long")
    solved = keep(solved)
    known = solved.where("segment is null").select("segment_id", "froms", "tos", "firsts")
    if solved.where("segment is not null").limit(1).count():
        single = solved.where("segment is not null").select("segment", "id", "last").mapInArrow(lean(_single_strings(length)), "segment_id binary, at int, string binary, id long, last long")
        first = single.groupBy("string").agg(F.min("id").alias("first"))
        found = single.join(first, "string").where("first < last").groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("at", "first"))).alias("x"))
        known = known.unionByName(found.select("segment_id", F.expr("transform(x, y -> y.at) froms"), F.expr("transform(x, y -> y.at + 1) tos"), F.expr("transform(x, y -> y.first) firsts")))
    named, named_bits = known_segments(known)
    wanted = spark.sparkContext.broadcast(named)
    runs = docs.select("id", "text").mapInArrow(lean(_occurrences(shared, bits, length, False, wanted, named_bits)), "segment_id binary, id long, tag long, start int")
    spans = F.expr(f"filter(transform(arrays_zip(froms, tos, firsts), x -> struct(x.firsts as first, start + x.froms as a, start + x.tos + {length - 1} as b)), x -> x.first < id)")
    return runs.join(known, "segment_id").select("id", "tag", F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("spans")).where("size(spans) > 0")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of the bytes under spans, and the text without them."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    kept, at = [], 0
    for a, b in joined:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return [(a, b) for a, b in joined], b"".join(kept)


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the characters that lie wholly within a run: valid UTF-8."""
    kept, at = [], 0
    for a, b in runs:
        while a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(text[at:a])
        at = max(a, b)
    kept.append(text[at:])
    return b"".join(kept)


def deduplicate(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), length: int = LENGTH, with_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """docs(doc_id, text, ...) -> ``columns``, n_bytes, n_removed, n_spans, kept_sha256 (with_text: also kept_text).

    ``kept_text`` loses whole characters only, so it may keep up to three bytes more on
    either side of a run than ``kept_sha256``, which is of the bytes.
    """
    d = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = first_occurrences(d, length, crowd).groupBy("id", "tag").agg(F.flatten(F.collect_set("spans")).alias("_spans"))
    whole = docs.select(*dict.fromkeys([*columns, "text"])).withColumns({"_id": F.coalesce("doc_id", F.lit(LAST_ID)), "_tag": F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = whole.join(found, (F.col("_id") == F.col("id")) & (F.col("_tag") == F.col("tag")), "left").drop("id", "tag", "_id", "_tag")
    schema = docs.select(*columns).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(text_bytes(batch["text"]), batch["_spans"].to_pylist(), strict=True):
                runs, kept = cut_spans(text, [(s["a"], s["b"]) for s in spans]) if spans else ([], text)
                rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), whole_characters(text, runs) if with_text else b""))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            out = [pa.array(c, k) for c, k in zip(cols[:4], [pa.int64()] * 3 + [pa.string()], strict=True)]
            if with_text:
                out.append(pa.array([x.decode() for x in cols[4]], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *out], schema.fieldNames())

    return joined.mapInArrow(lean(run), schema)
