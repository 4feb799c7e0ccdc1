"""Scans over blocks of a document against windows over the whole of it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from deckjobs.operators import cues, freeform, outline, scans, sections


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    got = rows(a)
    assert got == rows(b) and got


def lines_of(spark, n, docs=3):
    """Outline lines with labels, bare markers, blank lines and gaps in the numbers."""
    kinds = F.element_at(F.array(*map(F.lit, ("Title: a", "plain", "Scripture:", "POINT 1: x", " ", "12", "more", "Back to Title", "Image: “p"))), (F.xxhash64("id", F.lit(7)) % 9 + 9).cast("int") % 9 + 1)
    x = spark.range(n * docs).withColumn("line", kinds)
    return x.where("id % 11 <> 5").select((F.col("id") % docs).alias("doc_id"), F.floor(F.col("id") / docs).cast("int").alias("line_no"), "line")


@pytest.mark.parametrize("size", [1, 3, 64])
def test_outline_islands(spark, size):
    lines = lines_of(spark, 400)
    same(outline.outline_islands(lines, size), outline.outline_islands(lines))
    same(outline.entries(lines, size), outline.entries(lines))


@pytest.mark.parametrize("size", [1, 2, 50])
def test_sections_blocks_and_numbers(spark, size):
    rng = random.Random(size)
    words = ["SLIDE", "1:", "2", "a", "b"]
    runs = spark.createDataFrame([(d, p, n, r, rng.choice(words), r > 0) for d in range(2) for p in range(1, 20) for n in range(3) for r in range(rng.randint(1, 4))], "doc_id bigint, page int, line_no int, run_no int, text string, space_before boolean")
    same(sections.marker_sections(runs, block=size), sections.marker_sections(runs))
    geo = spark.createDataFrame([(d, p, n, rng.choice(["abc", "Words here"]), 0.0, rng.choice([50.0, 90.0]), 800.0 - 27 * n - 40 * (n // 3), rng.choice([20.0, 20.0, 28.0, 12.0])) for d in range(3) for p in range(1, 15) for n in range(8)], "doc_id bigint, page int, line_no int, text string, x0 double, x1 double, y double, size double")
    kept = freeform.drop_small_print(geo)
    same(freeform.drop_small_print(geo, spread=True), kept)
    same(freeform.with_gap(kept, spread=True), freeform.with_gap(kept))
    same(freeform.layout_blocks(kept, size), freeform.layout_blocks(kept))
    made = cues.cue_expand(outline.entries(lines_of(spark, 60)), default_copies=True)
    same(cues.cue_numbering(made, size), cues.cue_numbering(made))


def test_sums_and_rows_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 5, 2), (1, 9, None), (2, 3, None), (None, 1, 4), (None, 2, 5)], "doc_id bigint, at int, v int")
    for size in (1, 4):
        got = {(r.doc_id, r["at"]): (r.total, r.before) for r in scans.preceding(scans.running(rows, ["at"], {"total": F.col("v")}, size), ["at"], {"before": "v"}, size).where("doc_id is not null").collect()}
        assert got == {(1, 0): (None, None), (1, 5): (2, None), (1, 9): (2, 2), (2, 3): (None, None)}
    assert scans.running(rows.limit(0), ["at"], {"total": F.col("v")}, 4).collect() == []


def test_lower_quartile_is_element_n_div_4(spark):
    rng = random.Random(1)
    groups = {n: [rng.choice([1.5, 2.0, 2.0, 3.25, 7.0, rng.random()]) for _ in range(n)] for n in [1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 100, 4000, 4001]}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs] + [(0, None)], "n int, v double")
    got = {r.n: r.q for r in df.groupBy("n").agg(freeform.lower_quartile("v").alias("q")).collect()}
    assert got == {n: sorted(vs)[n // 4] for n, vs in groups.items()} | {0: None}


def test_one_document_of_a_million_lines(spark):
    """Spread over tasks, no window holds the document, and its gap is element n div 4 of all."""
    n = 1_000_000
    x = spark.range(n, numPartitions=8)
    gap = F.when(F.col("id") % 7 == 0, 40.0).otherwise(10.0 + (F.col("id") * 48271 % 1009) / 64)
    at = F.col("id") % 50
    lines = x.select(F.lit(1).cast("long").alias("doc_id"), (F.floor(F.col("id") / 50) + 1).cast("int").alias("page"), at.cast("int").alias("line_no"), F.lit("some text").alias("text"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("x1"), (5000.0 - 60.0 * at - gap).alias("y"), F.lit(20.0).alias("size"))
    kept = freeform.drop_small_print(lines, spread=True)
    ys = [(i % 50, 5000.0 - 60.0 * (i % 50) - (40.0 if i % 7 == 0 else 10.0 + i * 48271 % 1009 / 64)) for i in range(n)]
    gaps = sorted(a[1] - b[1] for a, b in zip(ys, ys[1:]) if b[0] and a[1] - b[1] > 0)
    assert freeform.line_gap(kept).first().gap == gaps[len(gaps) // 4]
    blocks = freeform.layout_blocks(kept, 1000)
    assert blocks.agg(F.max("block")).first()[0] >= n // 50
    assert blocks.select("doc_id", F.floor(F.col("page") / 1000).alias("b"), F.spark_partition_id().alias("p")).distinct().agg(F.count_distinct("b")).first()[0] == 21
