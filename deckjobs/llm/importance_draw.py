"""Importance resampling towards a target: hashed word windows, gains by bucket, a draw without replacement.

An untrained ``Split`` of the tokenizers library cuts ASCII-lowered text at everything that
is no ASCII letter or digit and no character beyond ASCII, and gives each word with its
offsets. White-space chunks are split once for each worker that remembers them; a word's
place in the text is its chunk's place plus its offset there. A window is a run of one to
``longest`` words, given by the offsets of its first and last word; the CRC-32 of the words
joined by single spaces follows from the words' own by the rule for joined strings, so no
window is ever built as a string. Windows are counted in ``buckets`` by their CRC.

The gain of a bucket is the scaled log of its smoothed share in the target over its share in
the documents; a document's weight is the floored mean of its windows' gains. Weight plus
Gumbel noise (from a hash of seed and id) ranks the documents, and the best ``share`` per
cent of those long enough are drawn: sampling without replacement in proportion to
importance, which needs no pass over the others.

Texts are split once; the buckets of each document (two bytes a window) are written to
shared storage, counted there, and read again for the weights.

Defined results: a null or empty text has no words and weight 0; a null doc_id is hashed as
empty and comes after every other id of its score; repeated rows are documents of their own;
of equal scores the smaller doc_id goes first, then fewer windows, then less weight; an
empty table gives an empty result, an empty target counts as no windows. Columns named in
``columns`` are carried through and must not have the names of results; others are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk_coder import ChunkCoder, binary_array
from .common import Words, keep, placed, text_bytes

BUCKETS = 10_000
LONGEST = 2
SHARE = 25
LEAST_WORDS = 20
SEED = 7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_features", "weight", "score", "rank")
#: Bytes of text that are looked at together; longer texts are cut between words.
STRETCH = 1 << 20
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")


def _byte_table() -> np.ndarray:
    """CRC-32 of each byte, by eight division steps."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _byte_table()


def _zeros_tables() -> list[np.ndarray]:
    """For each k, by byte of a remainder: what 2**k zero bytes after it make of it."""
    place = np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8)
    one = np.arange(256, dtype=np.uint32)[None, :] << place
    tables = [_TABLE[one & np.uint32(255)] ^ (one >> np.uint32(8))]
    while len(tables) < 31:
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return table[0][c & byte] ^ table[1][(c >> np.uint32(8)) & byte] ^ table[2][(c >> np.uint32(16)) & byte] ^ table[3][c >> np.uint32(24)]


_ZEROS = _zeros_tables()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of both parts and the second's length in bytes."""
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        on = (length >> k) & 1 == 1
        out[on] = _apply(_ZEROS[k], out[on])
    return out ^ second


def spaced(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with a space put after them."""
    c = ~crc
    return ~(_TABLE[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8)))


def splitter() -> ChunkCoder:
    """Start, end and CRC of each word of a chunk, in bytes: one character stands for one byte of UTF-8."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(SEPARATORS), "removed")

    def code(chunks: list[bytes]) -> list[list[int]]:
        out = []
        for chunk in chunks:
            flat: list[int] = []
            for _, (a, b) in split.pre_tokenize_str(chunk.decode("latin-1")):
                crc = zlib.crc32(chunk[a:b])
                flat += (a, b, crc - (crc >> 31 << 32))
            out.append(flat)
        return out

    return ChunkCoder(code)


def stretches(texts: list[bytes], limit: int = STRETCH) -> Iterator[tuple[list[int], list[bytes]]]:
    """Index and bytes of texts, about ``limit`` bytes at a time; a longer text is cut behind a byte between words."""
    at: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        a = 0
        while True:
            if len(text) - a <= limit:
                b = len(text)
            else:
                gap = _GAP.search(text, a + limit)
                b = gap.end() if gap else len(text)
            at.append(i)
            held.append(text[a:b])
            size += b - a
            a = b
            if size >= limit:
                yield at, held
                at, held, size = [], [], 0
            if a >= len(text):
                break
    if at:
        yield at, held


def windows(coder: ChunkCoder, texts: list[bytes], longest: int = LONGEST, limit: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, number of words in its window, CRC) of all windows of lowered texts, some texts at a time."""
    before = (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for at, some in stretches(texts, limit):
        chunks = Words(some, hashed=False)
        flat, n = coder.ids(binary_array(chunks.data, chunks.start, chunks.end))
        word = flat.reshape(-1, 3)
        text = np.asarray(at, np.int64)[np.repeat(chunks.doc, n // 3)]
        # the words before a cut, so that windows run over it
        text, crc, length = (np.concatenate(x) for x in zip(before, (text, word[:, 2].astype(np.int32).view(np.uint32), (word[:, 1] - word[:, 0]).astype(np.int64)), strict=True))
        old = len(before[0])
        run = crc
        for k in range(1, longest + 1):
            if k > 1:
                run = joined_crc(spaced(run[:-1]), crc[k - 1 :], length[k - 1 :])
            first = np.arange(len(run))
            whole = (first + k - 1 >= old) & (text[: len(run)] == text[k - 1 :]) if len(run) else np.zeros(0, bool)
            yield text[: len(run)][whole], np.full(int(whole.sum()), k), run[whole]
            if not len(run):
                break
        tail = max(0, len(text) - (longest - 1)) if longest > 1 else len(text)
        before = text[tail:], crc[tail:], length[tail:]


def features(texts: DataFrame, columns: tuple[str, ...] = ("doc_id",), longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """columns, n_words and ``ids``: the buckets of all windows of each text as little-endian integers, two bytes each (four beyond 65,536 buckets)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    source = texts.select(*columns, texts["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = splitter()
        for batch in batches:
            lowered = [t.lower() for t in text_bytes(batch["_text"])]
            parts: list[list[bytes]] = [[] for _ in lowered]
            n_words = np.zeros(len(lowered), np.int64)
            for text, k, crc in windows(coder, lowered, longest):
                if not len(text):
                    continue
                ids = (crc % np.uint32(buckets)).astype(kind)
                if k[0] == 1:
                    n_words += np.bincount(text, minlength=len(lowered))
                edge = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]])
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    parts[text[a]].append(ids[a:b].tobytes())
            more = [pa.array(n_words), pa.array([b"".join(p) for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *more], [*columns, "n_words", "ids"])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in columns)
    return source.mapInArrow(run, f"{carried}{', ' if carried else ''}n_words long, ids binary")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Windows in each bucket: a partial count for each task, added up; ``buckets`` numbers reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for ids in text_bytes(batch["ids"]):
                total += np.bincount(np.frombuffer(ids, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("ids").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the corpus') for each bucket, as whole numbers."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    n = float(len(corpus))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, n_words, n_features, weight: the floored mean gain of a text's windows."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    sent = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for raw in text_bytes(batch["ids"]):
                ids = np.frombuffer(raw, kind)
                n.append(len(ids))
                weight.append(int(sent.value[ids].sum()) // len(ids) if len(ids) else 0)
            more = [batch["n_words"], pa.array(n, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *more], [*columns, "n_words", "n_features", "weight"])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in columns)
    return found.mapInArrow(run, f"{carried}{', ' if carried else ''}n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel) from the first 32 bits of a hash of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.left(hashed, F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def drawn(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All docs with n_words, n_features, weight, score and, for those drawn, rank from 1.

    ``target`` needs a column ``text``. Drawn are floor(share * N / 100) of the N documents
    with ``least_words`` words.
    """
    if clash := sorted(set(columns) & {*RESULTS, "ids", "_text"}):
        raise ValueError(f"columns that would clash with results: {clash}")
    if "doc_id" not in columns:
        raise ValueError("columns must hold doc_id")
    found = keep(features(docs, columns, longest, buckets))
    aimed = features(target, (), longest, buckets)
    gain = gains(histogram(found, buckets), histogram(aimed, buckets))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    weights = keep(weighed(found, gain, columns).withColumns({"score": score, "_long": F.col("n_words") >= least_words}))
    n = weights.agg(F.count_if("_long").alias("n")).first()["n"]
    order = [F.col("_long").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    at = placed(weights, *order, name="_place")
    rank = F.when(F.col("_place") < share * n // 100, F.col("_place") + 1)
    return at.select(*columns, "n_words", "n_features", "weight", "score", rank.alias("rank"))
