"""SimHash near-duplicates found by anchor-point covering.

The 64 bits of a fingerprint are two halves; fingerprints that differ in at most three bits
differ in at most one bit of some half. The anchors of a half are the codewords of the
perfect Hamming code of length 31 (one bit of the half is left out): every point is within
covering radius 1 of exactly one anchor. Each fingerprint calls its nearest anchor home and
visits all anchors within radius plus threshold, 2: if two fingerprints differ in at most
one bit of a half, each visits the other's home. Visitors are compared with the residents
of an anchor, so a pair is looked at once or twice per half, never all pairs of an anchor.

Anchors with more residents than ``dense`` (a great family of near copies) are not compared
pair by pair. Their residents and visitors are linked through points between them instead:
two fingerprints are within three bits exactly if some point is within one bit of one and
two bits of the other, so each is dealt to the 2081 points within two bits and joined to
the least fingerprint within one bit of that point. That is exact and grows with the number
of fingerprints only.

Copies are one fingerprint from the start: all work is on distinct fingerprints.

Defined results: null or empty texts and texts without words have fingerprint zero and are
linked like any other; repeated rows all get their row; a null doc_id keeps its row but is
no component's name unless all of the component's ids are null; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lean, text_bytes
from .graph import components

SHINGLE = 3
THRESHOLD = 3
#: Residents of an anchor up to which they are compared one by one.
DENSE = 1024
_BLOCK = 1 << 15


def _syndromes() -> np.ndarray:
    """For each byte of a half and its value, the exclusive or of the numbers (1 to 31) of its set bits."""
    t = np.zeros((4, 256), np.uint32)
    for bit in range(31):
        t[bit // 8] ^= (((np.arange(256) >> bit % 8) & 1) * (bit + 1)).astype(np.uint32)
    return t


_SYNDROME = _syndromes()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of the ASCII-lower-cased text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - shingle]]
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in text_bytes(batch["text"])), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fp long")


def _syndrome(half: np.ndarray) -> np.ndarray:
    return _SYNDROME[0][half & 255] ^ _SYNDROME[1][(half >> 8) & 255] ^ _SYNDROME[2][(half >> 16) & 255] ^ _SYNDROME[3][half >> 24]


def _bit(number: np.ndarray) -> np.ndarray:
    """Mask of bit ``number`` (from 1); none for 0."""
    return np.where(number > 0, np.uint32(1) << (np.maximum(number, 1) - 1).astype(np.uint32), 0).astype(np.uint32)


def anchors(half: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Home anchor of each 31-bit point, and (index of points, anchor) of all anchors within two bits."""
    s = _syndrome(half)
    home = half ^ _bit(s)
    visits = [(np.arange(len(half)), home)]
    for i in range(1, 32):
        j = s ^ np.uint32(i)
        two = np.flatnonzero((s > 0) & (j > i))
        visits.append((two, half[two] ^ _bit(np.uint32(i)) ^ _bit(j[two])))
    return home, visits


def _keyed(visiting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for side in (0, 1):
                half = ((fp >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
                home, visits = anchors(half)
                for at, anchor in visits if visiting else [(np.arange(len(fp)), home)]:
                    if len(at):
                        key = anchor.astype(np.int64) | side << 31
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at].view(np.int64))], ["anchor", "fp"])

    return run


_ONE = np.array([1 << i for i in range(64)], np.uint64)
_TWO = np.array([1 << i | 1 << j for i, j in combinations(range(64), 2)], np.uint64)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All points within two bits of each fingerprint; ``near`` is the fingerprint if within one bit."""
    masks = np.concatenate([np.zeros(1, np.uint64), _ONE, _TWO])
    near = np.arange(len(masks)) <= 64
    for batch in batches:
        fp = batch["fp"].to_numpy()
        for i in range(0, len(fp), 64):
            some = fp[i : i + 64]
            point = (some.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)
            who = np.repeat(some, len(masks))
            yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(who), pa.array(who, mask=~np.tile(near, len(some)))], ["point", "fp", "near"])


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """distinct(fp) -> (a, b): pairs of distinct fingerprints such that the components are those of all pairs within three bits.

    Every pair within three bits whose anchors are not dense is in the result itself;
    around dense anchors the pairs in it connect exactly what all pairs would.
    """
    home = distinct.select("fp").mapInArrow(lean(_keyed(False)), "anchor long, fp long")
    visit = distinct.select("fp").mapInArrow(lean(_keyed(True)), "anchor long, fp long")
    crowd = keep(home.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("anchor"))
    crowded = crowd.limit(1).count() > 0
    residents = home.join(crowd, "anchor", "left_anti") if crowded else home
    close = F.bit_count(F.col("v.fp").bitwiseXOR(F.col("h.fp"))) <= THRESHOLD
    once = F.col("v.fp") != F.col("h.fp") if crowded else F.col("v.fp") > F.col("h.fp")
    met = visit.alias("v").join(residents.alias("h"), (F.col("v.anchor") == F.col("h.anchor")) & close & once)
    found = met.select(F.greatest("v.fp", "h.fp").alias("a"), F.least("v.fp", "h.fp").alias("b"))
    if not crowded:
        return found
    around = visit.join(crowd, "anchor", "left_semi").select("fp").distinct()
    points = around.mapInArrow(lean(_points), "point long, fp long, near long")
    hub = points.groupBy("point").agg(F.min("near").alias("least")).where("least is not null")
    through = points.join(hub, "point").where("fp <> least").select(F.greatest("fp", "least").alias("a"), F.least("fp", "least").alias("b")).distinct()
    return found.union(through)


def near_duplicates(docs: DataFrame, dense: int = DENSE, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Fingerprints are computed once and written; links and components are of distinct
    fingerprints, and only those that have a link take part in the last join by value.
    """
    fps = keep(fingerprints(docs, shingle))
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = components(links(distinct, dense))
    named = rooted.join(distinct.withColumnRenamed("fp", "node"), "node")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(names, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("named"))
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
