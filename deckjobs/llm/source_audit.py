"""How sources of a language differ in their words: frequent terms by iceberg prefix refinement.

A term is kept if ``least_docs`` documents of its language have it. Kept terms are found
level by level: prefixes of ``FIRST_LEVEL`` bytes first, then of twice as many each time. At
each level the documents that have a term of a prefix are counted; a prefix of fewer than
``least_docs`` is discarded with all that begins so, for no longer prefix can have more. A
term with its end byte (zero, which no term holds) is a prefix that cannot be extended:
those above the threshold are kept and leave the refinement. It ends when only they remain.
So the rare words of a corpus, most of its vocabulary, are never counted in full nor
shuffled.

Texts are read once: each task writes blocks of one language, with the block's distinct
terms and the count of each document and term. A block is megabytes in one row, so blocks are
written, read and sent to Python workers one or two at a time, however many a task has. Prefix counts of a block are whole-array
steps; blocks add up, for a document lies in one block. Survivors of a level reach the tasks
as a bit set of fixed size: two that fall together let a prefix through that is counted once
more and discarded then, none is lost.

Each (language, source) group and each language gives a kept term the smoothed share
p = 1 + floor(1000000000 (count + 5) / (N + 5 V)), all in whole numbers; groups are compared
by the sum of differences over all kept terms, in blocks of terms with all sources.

Defined results: null text, language and source are empty strings; rows that repeat are
documents of their own, whatever their id; a group without terms takes part; a language
without kept terms has differences of 0 and no terms; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunk_coder import binary_array
from .common import Words, keep, lean, mixed, small_batches, text_bytes

LEAST_DOCS = 30
FIRST_LEVEL = 4
SMOOTH = 5
SCALE = 1_000_000_000
MOST_TERMS = 50
#: Bytes of text in a block of documents.
BLOCK = 1 << 23
#: Terms times sources in one block of the comparison.
CELLS = 1 << 17
#: Bits of a level's survivors, 8 MB at most.
BITS = 1 << 26
_SPLIT = bytes(b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256))

BLOCKS = "lang string, sources array<string>, terms array<binary>, doc_source binary, pair_doc binary, pair_term binary, pair_n binary"


def distinct_terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of lowered texts, each with its end byte; text, term and count of every pair that occurs."""
    data = np.frombuffer((b"\0".join(texts) + b"\0").translate(_SPLIT), np.uint8)
    inside = data > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    doc = np.searchsorted(offset, start, "right") - 1
    coded = binary_array(data, start, end + 1).dictionary_encode()
    n = max(1, len(coded.dictionary))
    pair, count = np.unique(doc * n + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, pair // n, pair % n, count


def parts_of_text(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text, cut behind bytes that belong to no term."""
    a = 0
    while a < len(text):
        b = a + limit
        while b < len(text) and _SPLIT[text[b]]:
            b += 1
        yield text[a : b + 1]
        a = b + 1


def merged(parts: Iterator[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As ``distinct_terms`` for one text in parts."""
    terms, counts = pa.array([], pa.binary()), np.zeros(0, np.int64)
    for part in parts:
        more, _, which, n = distinct_terms([part])
        coded = pa.concat_arrays([terms, more.take(pa.array(which))]).dictionary_encode()
        terms = coded.dictionary
        counts = np.bincount(coded.indices.to_numpy(), np.concatenate([counts, n]), len(terms)).astype(np.int64)
    return terms, np.zeros(len(terms), np.int64), np.arange(len(terms)), counts


def profile(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of documents of one language: their sources, distinct terms, and counts by document and term."""

    def row(lang: str, sources: list[str], found: tuple) -> pa.RecordBatch:
        names = sorted(set(sources))
        at = {s: i for i, s in enumerate(names)}
        terms, doc, term, n = found
        ints = [np.array([at[s] for s in sources], "<i4"), doc.astype("<i4"), term.astype("<i4"), n.astype("<i4")]
        listed = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([names]), listed, *(pa.array([x.tobytes()], pa.binary()) for x in ints)], ["lang", "sources", "terms", "doc_source", "pair_doc", "pair_term", "pair_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[str], list[bytes]]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), text_bytes(batch["text"]), strict=True):
                if len(text) > block:
                    yield row(lang, [source], merged(parts_of_text(text.lower(), block)))
                    continue
                sources, texts = held.setdefault(lang, ([], []))
                sources.append(source)
                texts.append(text.lower())
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sum(sizes.values()) >= 4 * block or sizes[lang] >= block:
                    most = max(sizes, key=sizes.__getitem__)
                    sources, texts = held.pop(most)
                    del sizes[most]
                    yield row(most, sources, distinct_terms(texts))
        for lang, (sources, texts) in held.items():
            yield row(lang, sources, distinct_terms(texts))

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(lean(run), BLOCKS)


def _spans(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, terms.offset * 4).astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    return data[: offsets[-1]], offsets


def prefix_bits(lang: str, terms: pa.Array, length: int, bits: int) -> np.ndarray:
    """Place of each term's prefix, with its language, in the bit set."""
    data, at = _spans(terms)
    seed = Words.span_hash(np.frombuffer(lang.encode() + b"\0", np.uint8), np.array([0]), np.array([len(lang.encode())]))
    return mixed(Words.span_hash(data, at[:-1], np.minimum(at[:-1] + length, at[1:])) ^ seed) % np.uint64(bits)


def _open(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        ints = (np.frombuffer(batch[c][i].as_py(), "<i4") for c in ("doc_source", "pair_doc", "pair_term", "pair_n"))
        terms = batch["terms"][i].values.cast(pa.binary())
        yield batch["lang"][i].as_py(), batch["sources"][i].as_py(), pa.concat_arrays([terms]), *ints


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1


def prefix_counts(blocks: DataFrame, length: int, before: int, survivors: np.ndarray | None) -> DataFrame:
    """lang, prefix, n_docs over all blocks, for terms whose prefix of ``before`` bytes survived and was no whole term."""
    sent = None if survivors is None else blocks.sparkSession.sparkContext.broadcast(survivors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, terms, _, doc, term, _ in _open(batch):
                alive = np.ones(len(terms), bool)
                if sent is not None:
                    size = pc.binary_length(terms).to_numpy()
                    alive = (size > before) & _has(sent.value, prefix_bits(lang, terms, before, 64 * len(sent.value)))
                prefix = pc.binary_slice(terms, 0, length).dictionary_encode()
                known = alive[term]
                n = max(1, len(prefix.dictionary))
                pair = np.unique(doc[known].astype(np.int64) * n + prefix.indices.to_numpy()[term[known]])
                count = np.bincount(pair % n, minlength=len(prefix.dictionary))
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), prefix.dictionary.take(pa.array(at)), pa.array(count[at])], ["lang", "prefix", "n_docs"])

    partial = blocks.select("lang", "sources", "terms", "doc_source", "pair_doc", "pair_term", "pair_n").mapInArrow(lean(run), "lang string, prefix binary, n_docs long")
    return partial.groupBy("lang", "prefix").agg(F.sum("n_docs").alias("n_docs"))


def bit_set(prefixes: DataFrame, length: int, bits: int = BITS) -> np.ndarray:
    """The bits of (lang, prefix) rows, joined from partial ones; as many numbers as the set has words reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang in set(langs):
                of = pa.concat_arrays([batch["prefix"].filter(pa.array([x == lang for x in langs])).cast(pa.binary())])
                place = np.unique(prefix_bits(lang, of, length, bits))
                word = (place >> np.uint64(6)).astype(np.int64)
                at, first = np.unique(word, return_index=True)
                mask = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask.view(np.int64))], ["word", "mask"])

    out = np.zeros(bits // 64, np.uint64)
    rows = prefixes.select("lang", "prefix").mapInArrow(lean(run), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def whole(prefix: Column) -> Column:
    """Is it a term with its end byte?"""
    return F.substring(F.hex(prefix), -2, 2) == "00"


def kept_terms(blocks: DataFrame, least_docs: int = LEAST_DOCS, first_level: int = FIRST_LEVEL, bits: int = BITS) -> DataFrame:
    """lang, term, n_docs: the terms of at least ``least_docs`` documents of their language."""
    found, survivors, before, length = [], None, 0, first_level
    while True:
        with small_batches(blocks.sparkSession, 1):
            level = keep(prefix_counts(blocks, length, before, survivors).where(F.col("n_docs") >= least_docs))
        found.append(level.where(whole(F.col("prefix"))))
        rest = level.where(~whole(F.col("prefix")))
        if rest.isEmpty():
            break
        survivors, before, length = bit_set(rest, length, bits), length, 2 * length
    terms = found[0]
    for more in found[1:]:
        terms = terms.unionByName(more)
    bare = F.decode(F.unhex(F.expr("left(hex(prefix), length(hex(prefix)) - 2)")), "UTF-8")
    return terms.select("lang", bare.alias("term"), "n_docs")


def term_counts(blocks: DataFrame, kept: DataFrame, bits: int = BITS) -> DataFrame:
    """lang, source, term, n: occurrences of kept terms, of those there are any."""
    ended = kept.select("lang", F.unhex(F.concat(F.hex(F.encode("term", "UTF-8")), F.lit("00"))).alias("prefix"))
    endless = 1 << 30
    sent = blocks.sparkSession.sparkContext.broadcast(bit_set(ended, endless, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sources, terms, doc_source, doc, term, count in _open(batch):
                alive = _has(sent.value, prefix_bits(lang, terms, endless, 64 * len(sent.value)))[term]
                n = max(1, len(terms))
                key, at = np.unique(doc_source[doc[alive]].astype(np.int64) * n + term[alive], return_inverse=True)
                total = np.bincount(at, count[alive], len(key)).astype(np.int64)
                names = pa.array(sources, pa.string()).take(pa.array(key // n))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), names, terms.take(pa.array(key % n)), pa.array(total)], ["lang", "source", "prefix", "n"])

    partial = blocks.mapInArrow(lean(run), "lang string, source string, prefix binary, n long")
    total = partial.groupBy("lang", "source", "prefix").agg(F.sum("n").alias("n"))
    return total.join(ended, ["lang", "prefix"], "left_semi").select("lang", "source", F.decode(F.expr("unhex(left(hex(prefix), length(hex(prefix)) - 2))"), "UTF-8").alias("term"), "n")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), exact however large the counts; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(SMOOTH)), wide(total) + wide(terms) * F.lit(SMOOTH)
    return F.call_function("div", top, F.nullif(bottom, F.lit(0))) + 1


class Audit(NamedTuple):
    """Kept terms (lang, term, n_docs); groups (lang, source, n, n_terms); counts (lang, source, term, n, p)."""

    kept: DataFrame
    groups: DataFrame
    counts: DataFrame


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, block: int = BLOCK, first_level: int = FIRST_LEVEL, bits: int = BITS) -> Audit:
    """The counts that all reports rest on; each is written to shared storage."""
    with small_batches(docs.sparkSession):
        blocks = keep(profile(docs, block), wide=True)
    kept = keep(kept_terms(blocks, least_docs, first_level, bits))
    counts = term_counts(blocks, kept, bits)
    with small_batches(docs.sparkSession, 1):
        counts = keep(counts)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = blocks.select("lang", F.explode("sources").alias("source")).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = keep(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_terms", F.lit(0)).alias("n_terms")))
    shares = counts.join(groups.select("lang", "source", F.col("n").alias("_total"), "n_terms"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "n", share(F.col("n"), F.col("_total"), F.col("n_terms")).alias("p"))
    return Audit(kept, groups, keep(shares))


def differences(found: Audit, cells: int = CELLS) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum over all kept terms of their shares' difference.

    Terms are dealt into blocks of about ``cells`` terms times sources; a block has the
    shares of its terms for all sources (the share of no occurrence where there is none) and
    gives one partial sum for each pair, which is the size of the result.
    """
    per_lang = found.groups.groupBy("lang").agg(F.greatest(F.ceil(F.count("*") * F.max("n_terms") / cells), F.lit(1)).alias("n_blocks"))
    none = F.coalesce(share(F.lit(0), F.col("n"), F.col("n_terms")), F.lit(0))
    every = found.groups.join(per_lang, "lang").select("lang", "source", none.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("part"))
    some = found.counts.join(per_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), "n_blocks").alias("part"), "source", "term", "p")
    # each block also needs the terms that fewer sources have: all of a term's rows are in one block
    names = found.kept.join(per_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), "n_blocks").alias("part"), F.lit(None).cast("string").alias("source"), "term", F.lit(0).cast("long").alias("p"))

    def run(key: tuple, shares: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        sources = np.sort(groups["source"].to_numpy(object))
        base = groups.set_index("source")["p"].reindex(sources).to_numpy(np.int64)
        term, terms = pd.factorize(shares["term"])
        there = shares["source"].notna().to_numpy(bool)
        grid = np.tile(base, (len(terms), 1))
        grid[term[there], pd.Index(sources).get_indexer(shares["source"][there])] = shares["p"].to_numpy(np.int64)[there]
        rows = []
        for i, source in enumerate(sources):
            total = np.abs(grid - grid[:, [i]]).sum(0)
            other = np.arange(len(sources)) != i
            rows.append(pd.DataFrame({"lang": key[0], "source": source, "item": sources[other], "value": total[other]}))
        return pd.concat(rows)

    partial = some.unionByName(names).groupBy("lang", "part").cogroup(every.groupBy("lang", "part")).applyInPandas(run, "lang string, source string, item string, value long")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def typical(found: Audit) -> DataFrame:
    """lang, source, item (a kept term that the group has, of a greater share than in the language), value: by how much."""
    sums = found.groups.groupBy("lang").agg(F.sum("n").alias("_total"), F.max("n_terms").alias("_terms"))
    own = found.counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(sums, "lang")
    q = own.select("lang", "term", share(F.col("n"), F.col("_total"), F.col("_terms")).alias("q"))
    return found.counts.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def report(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, **settings) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all other sources, and the most typical terms."""
    found = audit(docs, least_docs, **settings)
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.encode("item", "UTF-8")))
    pairs = differences(found).withColumn("rank", place).withColumn("part", F.lit("pair"))
    terms = typical(found).withColumn("rank", place).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
