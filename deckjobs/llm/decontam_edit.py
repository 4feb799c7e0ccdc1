"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item with an error budget of k edits is cut into k + 1 pieces: any text within
k edits of the item has at least one piece unchanged. Texts are searched for all pieces at
once by an Aho-Corasick automaton; around each hit Myers' bit-parallel distance decides
whether the whole item occurs within its budget.

Texts and items are compared lower-cased, with runs of white space as one space. The budget
is ``error_rate`` of the item's length, rounded down; items too short for one edit are
searched for as they are. Items are sent to the tasks in blocks of bounded size
(``BLOCK_CHARS``), one pass over the documents for each block and one block at a time,
whatever the size of the benchmark.

Defined results: null or empty documents match nothing; null or blank items are not searched
for, and all others are; several texts under one item_id are all searched for; a repeated
text is found under its smallest item_id; an item without an id is searched for too, and
stands as null, last, among the items found; repeated documents all get their rows; empty
tables give empty or unmarked results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, lean

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000


def clean(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(item: str, error_rate: float) -> int:
    return int(len(item) * error_rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 parts of the item of nearly equal length, each with its offset."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers_ends(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int]:
    """Least distance of the pattern to any substring of text, and the first end with it; (k + 1, -1) if above k."""
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, at = k + 1, -1
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        if distance < best:
            best, at = distance, i + 1
    return best, at


class Matcher:
    """All pieces of a block of items in one automaton; items are known by their place in the block."""

    def __init__(self, texts: list[str], error_rate: float):
        self.items: list[tuple[str, int, dict[str, int]]] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for n, text in enumerate(texts):
            k = budget_of(text, error_rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            self.items.append((text, k, masks))
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item -> (distance, end, number of pieces hit) of the items within their budget."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items or not text:
            return found
        spans: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                item, k, _ = self.items[n]
                a = max(end + 1 - length - offset - k, 0)
                b = end + 1 - length - offset + len(item) + k
                own = spans.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1] = [min(own[-1][0], a), max(own[-1][1], b), own[-1][2] + 1]
                else:
                    own.append([a, b, 1])
        for n, own in spans.items():
            item, k, masks = self.items[n]
            hits = sum(x[2] for x in own)
            best, at = k + 1, -1
            for a, b, _ in own:
                j = text.find(item, a, b)
                d, e = (0, j - a + len(item)) if j >= 0 else myers_ends(masks, len(item), text[a:b], k)
                if d < best:
                    best, at = d, a + e
            if best <= k:
                found[n] = (best, at, hits)
        return found


Block = tuple[list[int | None], list[str]]


def blocks_of(benchmark: DataFrame, block_chars: int) -> Iterator[Block]:
    """Ids and cleaned texts of the items in blocks of bounded size, streamed through the driver one block at a time."""
    spaces = F.trim(F.regexp_replace("text", r"\s+", " "))
    items = benchmark.where("text is not null").groupBy(F.lower(spaces).alias("text")).agg(F.min("item_id").alias("item_id"))
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for r in items.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator():
        text = clean(r["text"])
        if not text:
            continue
        if texts and size + len(text) > block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _in_order(ids: set[int | None]) -> list[int | None]:
    return sorted(ids, key=lambda i: (i is None, i or 0))


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) x benchmark(item_id, text) -> rows (doc_id, item_id, distance, budget, match_end, pieces_hit), one for each document and text of an item it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, budget int, match_end int, pieces_hit int"

    def search(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = sent.value
            matcher = Matcher(texts, error_rate)
            for batch in batches:
                rows = [
                    (doc, ids[n], d, matcher.items[n][1], end, hits)
                    for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                    for n, (d, end, hits) in matcher.matches(clean(text)).items()
                ]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], ["doc_id", "item_id", "distance", "budget", "match_end", "pieces_hit"])

        found = keep(docs.select("doc_id", "text").mapInArrow(lean(run), schema))
        sent.destroy()
        return found

    found = [search(b) for b in blocks_of(benchmark, block_chars)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _found_in(sent, error_rate: float, names: list[str], only_hits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns ``names`` of documents with ``items``; ``only_hits``: of documents that hold an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        matcher = Matcher(texts, error_rate)
        for batch in batches:
            items = pa.array([_in_order({ids[n] for n in matcher.matches(clean(t))}) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([*(batch[c] for c in names), items], [*names, "items"])
            yield out.filter(pa.array([len(x) > 0 for x in items])) if only_hits else out

    return run


def marked(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("doc_id",), error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``columns`` of docs with ``items`` (ids of the items held, ascending), ``n_items`` and ``contaminated``.

    A benchmark of one block takes one pass over the documents, without a shuffle. For more
    blocks the documents are written once with a row number; each block's pass keeps only
    the rows it hits, and these are joined back, so that one block is in memory at a time.
    """
    spark = docs.sparkSession
    blocks = blocks_of(benchmark, block_chars)
    block, following = next(blocks, None), next(blocks, None)
    names = list(columns)
    empty = F.expr("cast(array() as array<bigint>)")
    if block is None:
        out = docs.select(*names).withColumn("items", empty)
    elif following is None:
        sent = spark.sparkContext.broadcast(block)
        schema = docs.select(*names).schema.add("items", T.ArrayType(T.LongType()))
        out = docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(lean(_found_in(sent, error_rate, names, False)), schema)
    else:
        rows = keep(docs.select(*dict.fromkeys([*names, "text"])).withColumn("_row", F.monotonically_increasing_id()))
        hits = None
        while block is not None:
            sent = spark.sparkContext.broadcast(block)
            found = keep(rows.select("_row", "text").mapInArrow(lean(_found_in(sent, error_rate, ["_row"], True)), "_row long, items array<long>"))
            sent.destroy()
            hits = found if hits is None else hits.union(found)
            block, following = following, next(blocks, None)
        split = F.struct(F.col("item").isNull().alias("none"), F.col("item").alias("id"))
        held = hits.select("_row", F.explode("items").alias("item")).groupBy("_row").agg(F.transform(F.sort_array(F.collect_set(split)), lambda x: x["id"]).alias("items"))
        out = rows.join(held, "_row", "left").select(*names, F.coalesce("items", empty).alias("items"))
    return out.withColumn("n_items", F.size("items")).withColumn("contaminated", F.size("items") > 0)
