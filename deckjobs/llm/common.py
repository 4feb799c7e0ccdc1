"""Helpers shared by the operators: scratch tables, byte-level hashing in numpy, ordering."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts after every real id; stands for a null id where an order is needed.
LAST_ID = 2**63 - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def scratch(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    The folder is the one named in ``spark.checkpoint.dir``. Without that setting a session
    of one machine (a local test) gets a temporary one; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="deckjobs-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/deckjobs-{uuid.uuid4().hex}"


def keep(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write a table to shared storage and read it again: cuts the lineage, survives lost executors.

    ``wide``: rows of megabytes each, of which neither writer nor reader holds more than a few.
    """
    path = scratch(df.sparkSession)
    few = {"parquet.block.row.count.limit": "2", "parquet.page.size.row.check.min": "1"} if wide else {}
    df.write.options(compression="zstd", **few).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """What is run inside sends rows to Python workers in smaller batches, so that these stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Asks the C library to give freed memory back; there is none such outside glibc.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Memory that Arrow and the C library hold though it is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, which gives freed memory back at its end and about once a second.

    A Python worker lives on for later tasks and stages; without this it keeps the most that any of them needed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for made in run(batches):
                yield made
                del made
                if time.monotonic() - last > 1:
                    give_back()
                    last = time.monotonic()
        finally:
            give_back()

    return task


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id is in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> _S32)) * _MIX2
    return h ^ (h >> _S32)


class Words:
    """White-space words of many byte texts with 64-bit hashes, all by whole-array steps.

    ``doc`` is the index of the text of each word, ``start`` and ``end`` its place in
    ``data``; ``hash`` depends on the word's bytes only.
    """

    SPACE = np.zeros(256, bool)
    SPACE[[9, 10, 11, 12, 13, 32]] = True

    def __init__(self, texts: list[bytes], hashed: bool = True):
        joined = b"\n".join(texts) + b"\n"
        self.data = data = np.frombuffer(joined, np.uint8)
        gap = self.SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.doc = np.searchsorted(self.offset, self.start, "right") - 1
        if hashed:
            self.hash = self.span_hash(data, self.start, self.end)

    @staticmethod
    def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for every pair, by its bytes and length only."""
        return mixed(span_sums(data, start, end) + (end - start).astype(np.uint64) * _MIX)


#: Values whose powers are looked at at once.
_STRETCH = 1 << 16
_P = pow(0x9E3779B97F4A7C15, 1, 2**64)
_P_INVERSE = pow(_P, -1, 2**64)


def _powers(base: int) -> np.ndarray:
    t = np.full(_STRETCH + 1, base, np.uint64)
    t[0] = 1
    return np.cumprod(t)


_POWERS, _INVERSE = _powers(_P), _powers(_P_INVERSE)


def _prefix_sums(values: np.ndarray, at: np.ndarray, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial sums modulo 2**64 of values[:i] for each i in ``at`` (ascending), and (``inverse``) the power -i.

    The values are taken in stretches, so that a long text costs no table of its own length.
    """
    sums, powers = np.zeros(len(at), np.uint64), np.ones(len(at) if inverse else 0, np.uint64)
    total = 0
    for a in range(0, len(values) + 1, _STRETCH):
        some = values[a : a + _STRETCH]
        local = np.concatenate([np.zeros(1, np.uint64), np.cumsum((some.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(some)])])
        ahead = pow(_P, a, 2**64)
        i, j = np.searchsorted(at, [a, a + _STRETCH])
        if j > i:
            sums[i:j] = local[at[i:j] - a] * np.uint64(ahead) + np.uint64(total)
            if inverse:
                powers[i:j] = _INVERSE[at[i:j] - a] * np.uint64(pow(_P_INVERSE, a, 2**64))
        total = (total + ahead * int(local[-1])) % 2**64
    return sums, powers


def span_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair; starts and ends are ascending."""
    if not len(start):
        return np.zeros(0, np.uint64)
    low, inverse = _prefix_sums(values, start, True)
    return (_prefix_sums(values, end, False)[0] - low) * inverse


def lowered(texts: Iterable[bytes]) -> list[bytes]:
    """ASCII letters in lower case."""
    return [t.lower() for t in texts]


def pieces_of(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each, so that arrays over them stay small."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if texts:
        yield first, len(texts)


def ranked(ids: DataFrame, key: str) -> DataFrame:
    """Rows in ascending ``key`` order with ``rank`` from 0, nulls first.

    Range partitions are sorted locally and written once; each partition's first rank is
    the sum of the sizes of those before it (a table of one row per partition), so no task
    sees more than its own range.
    """
    spark = ids.sparkSession
    there = keep(
        ids.repartitionByRange(shuffle_width(spark), F.col(key).asc_nulls_first())
        .sortWithinPartitions(F.col(key).asc_nulls_first())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = there.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    first, starts = 0, []
    for r in sizes:
        starts.append((r["_part"], first))
        first += r["_n"]
    starts = spark.createDataFrame(starts, "_part long, _first long")
    return (
        there.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_first")
    )


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Rows with their place (from 0) in an order of several columns, which may go either way.

    As ``ranked``: ranges are sorted locally and written once, and a range begins where the
    sizes of those before it end. ``rows`` should be a kept table; ranges are sampled from it.
    """
    spark = rows.sparkSession
    there = keep(rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    first, starts = 0, []
    for r in there.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect():
        starts.append((r["_part"], first))
        first += r["_n"]
    begins = spark.createDataFrame(starts, "_part long, _first long")
    place = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return there.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn(name, place).drop("_at", "_part", "_first")
