"""Token ids in files: frequency-ranked, in byte-aligned variable-length code.

Every id is replaced by its rank in the corpus (0: most frequent). A block holds the ranks
of whole documents: a control stream with two bits a value (its number of bytes less one,
four values a byte, lowest bits first) apart from a data stream with the values' bytes in
little-endian order. Reading looks the lengths of four values up in a table at once.

A store is a folder with three Parquet tables: ``blocks`` (shard, block, start of the block
in its shard, ids and lengths of its documents, control, data), ``ranks`` (rank, id) and
``shards`` (shard, first: number of ids in all shards before). Shards are in ascending
order of doc_id.

Defined results: a null or empty text is stored as the end id alone; a null doc_id sorts
first; repeated ids are all stored; an empty table gives an empty store; other columns of
the input are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_coder import ChunkCoder, binary_array
from .common import Words, keep, pieces_of, scratch, shuffle_width, text_bytes

#: About so many ids make a block; a document is never split.
BLOCK_IDS = 1 << 18
_LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)[None, :]) & 3).astype(np.uint8) + np.uint8(1)
_coders: dict[str, ChunkCoder] = {}


def word_coder(path: str) -> ChunkCoder:
    """The tokenizer's ids of white-space words: it drops white space and never looks across it."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def code(chunks: list[bytes]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

        _coders[path] = ChunkCoder(code)
    return _coders[path]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = ~_LETTER[33:127]
_SIGN[39] = False


def parts_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Parts of the words that the tokenizer codes alike alone or together, and the text of each.

    It drops white space, lower-cases, and ends a token between an ASCII letter or digit
    and an ASCII sign, but for apostrophes. Texts that may hold the name of a special token
    are only cut at white space.
    """
    plain = not any(b"<|" in t for t in texts)
    words = Words([t.lower() for t in texts] if plain else texts, hashed=False)
    start, end, data = words.start, words.end, words.data
    if plain and len(start):
        letter, sign = _LETTER[data], _SIGN[data]
        inner = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    return binary_array(data, start, end), np.searchsorted(words.offset, start, "right") - 1


def id_type(tokenizer: str) -> str:
    """Little-endian unsigned integers wide enough for the tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """doc_id and ``ids``, the ids of the whole text and the end id as integers of type ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(tokenizer)
        end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        for batch in batches:
            texts = list(text_bytes(batch["text"]))
            out = []
            for a, b in pieces_of(texts, 1 << 21):
                parts, doc = parts_of(texts[a:b])
                ids, n = coder.ids(parts)
                ends = np.cumsum(np.bincount(doc, n, b - a).astype(np.int64))
                raw = ids.astype(kind).tobytes()
                out += [raw[width * x : width * y] + end for x, y in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(text_bytes(batch["ids"])), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return run


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    n = len(values)
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros((n + 3) // 4 * 4, np.uint8)
    codes[:n] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    four = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block; ``_LENGTHS`` gives the sizes of four values for each control byte."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    first = np.cumsum(size) - size
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = padded[first]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= padded[first[more] + k] << np.uint32(8 * k)
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the store of docs(doc_id, text) to ``path``.

    Texts are tokenized once; the ids are kept, counted (a partial count for each task, a
    table of the vocabulary's size), dealt out by ranges of doc_id and packed by partition.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer)
    width = np.dtype(kind).itemsize
    ids = keep(encoded(docs, tokenizer, end_id, kind))
    counts = ids.mapInArrow(_counts(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    order = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy()
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
    rank[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(rank)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, block = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values = sent.value[np.frombuffer(b"".join(held), kind)]
            control, data = pack(values)
            row = {"shard": [shard], "block": [block], "start": [start], "n_ids": [len(values)], "doc_ids": [names], "lengths": [[len(x) // width for x in held]], "control": [control], "data": [data]}
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            for name, one in zip(batch["doc_id"].to_pylist(), text_bytes(batch["ids"]), strict=True):
                names.append(name)
                held.append(one)
                size += len(one) // width
                if size >= BLOCK_IDS:
                    yield flush()
                    start, block, names, held, size = start + size, block + 1, [], [], 0
        if held:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    in_order = ids.repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    in_order.mapInArrow(packed, "shard int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    first, rows = 0, []
    for r in sizes:
        rows.append((r["shard"], first))
        first += r["n"]
    spark.createDataFrame(rows, "shard int, first long").coalesce(1).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before) and ``ids`` (little-endian 32 bit) from a store's files."""
    order = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(order)
    shards = spark.read.parquet(f"{path}/shards")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = sent.value[unpack(r["control"], r["data"], r["n_ids"])].astype("<u4").tobytes()
                ends = np.cumsum(r["lengths"])
                starts = ends - r["lengths"]
                raw = [ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"] + r["first"]), pa.array(raw, pa.binary())], ["doc_id", "start", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(shards), "shard")
    return blocks.mapInArrow(unpacked, "doc_id long, start long, ids binary")


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids."""
    return stored.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def stored(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs to a new store under the cluster's shared folder and read it back."""
    path = scratch(docs.sparkSession)
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)

