"""The pipeline's stages against plain versions on a small table."""

from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest

from deckjobs.llm import simhash_cover
from tests.llm.test_exact import brute_components, brute_removed


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["the", "house", "and", "river", "stone", "walks", "under", "blue", "light", "over"]) + rng.choice(["", "s", "ing"]) for _ in range(n))
    passage, leak = say(60), say(25)
    rows = [(i, say(rng.randint(30, 90)), "en", "s", 0) for i in range(30)]
    rows += [(40, rows[3][1], "en", "s", 0), (41, rows[3][1], "en", "t", 0), (50, say(20) + " " + passage + " " + say(20), "en", "s", 0), (51, say(20) + " " + passage, "en", "s", 0), (60, say(10) + " " + leak, "en", "s", 0), (70, None, None, "s", 0), (71, "123 !!", "en", None, 6), (72, "é" * 200, "fr", "s", 0)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows


def test_stages(spark, small):
    where, rows = small
    docs = spark.read.parquet(f"{where}/documents.parquet")
    a = cp.language(spark, docs, where)
    kept = {r.doc_id: r.text for r in a.collect()}
    assert set(kept) == {r[0] for r in rows} - {70, 71} and a.columns == list(cp.COLUMNS)
    b = cp.near_duplicates(spark, a, where)
    ids = sorted(kept)
    root = brute_components([simhash_cover.fingerprint(kept[i].encode()) for i in ids])
    left = {r.doc_id: r.text for r in b.collect()}
    assert set(left) == {ids[r] for r in root} and 3 in left and 40 not in left and b.columns == list(cp.COLUMNS)
    c = cp.repeated_passages(spark, b, where)
    short = {r.doc_id: r for r in c.collect()}
    removed = {x[0]: x[2] for x in brute_removed(list(left.items()))}
    assert set(short) == set(left) and removed[51] > 200 and removed[50] == 0
    for i, r in short.items():
        assert len(left[i].encode()) - len(r.text.encode()) <= removed[i] and r.n_chars == len(r.text) and (removed[i] or r.text == left[i])
    d = cp.benchmark_leaks(spark, c, where)
    assert {r.doc_id for r in d.collect()} == set(short) - {60} and d.columns == list(cp.COLUMNS)
    assert cp.tokens(spark, d, where).count() == len(short) - 1


def test_run_and_empty(spark, small, tmp_path):
    where, rows = small
    out = cp.run(spark, where)
    assert "ids_sha256" in out.columns and out.count() == len(rows) - 2 - 2 - 1
    spark.read.parquet(f"{where}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
