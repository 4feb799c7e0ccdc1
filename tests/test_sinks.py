"""Presentation files, rejects and stores."""

from __future__ import annotations

import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from deckjobs.operators import cues, outline
from deckjobs.sources import store, tables

DECKS = "doc_id bigint, name string, cue_ids array<string>, cues array<struct<cue_no: int, name: string>>"


def files(path):
    """Files that a reader looks at."""
    return sorted(f for d, _, names in os.walk(path) for f in names if f.endswith(".pro") and "/_job" not in d)


def decks(spark, *names):
    return spark.createDataFrame([(i, n, [f"c{i}"], [(1, f"Título {i}\n“x”")]) for i, n in enumerate(names)], DECKS)


def test_files_are_named_apart_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    given = decks(spark, "My Message", "my message", "a/b:c", "", "Talk (3)", "My Message", None)
    tables.sink_presentations(given.repartition(3), path)
    assert files(path) == sorted(["My Message.pro", "my message (1).pro", "a-b-c.pro", "Presentation.pro", "Talk (3) (4).pro", "My Message (5).pro", "Presentation (6).pro"])
    back = tables.src_presentations(spark, path, DECKS)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, given.collect()))
    assert {(r.doc_id, r.idx, r.name) for r in cues.src_cues(back).collect()} == {(i, 0, f"Título {i}\n“x”") for i in range(7)}
    tables.sink_presentations(decks(spark, "only"), path)
    assert files(path) == ["only.pro"]
    tables.sink_presentations(decks(spark, "more"), path, "append")
    assert files(path) == ["more.pro", "only.pro"]
    tables.sink_presentations(given.limit(0), path)
    assert files(path) == [] and tables.src_presentations(spark, path, DECKS).collect() == []


def test_decks_are_read_by_folders_not_from_a_list_of_files(spark, tmp_path):
    path = tmp_path / "out"
    given = decks(spark, "a", "_b", ".c", "d")
    tables.sink_presentations(given.repartition(3), str(path))
    back = tables.src_presentations(spark, str(path), DECKS)
    assert back.inputFiles() == [] and back.rdd.getNumPartitions() <= 4
    assert sorted(map(repr, back.collect())) == sorted(map(repr, given.collect()))
    for at in ("by hand", "part-x/deeper", "part-x/_job-y"):
        (path / at).mkdir(parents=True)
        (path / at / "e.pro").write_text('{"doc_id": 9, "name": "e"}\r\n\n{"doc_id": 10}\n')
    (path / "f.pro").write_text('{"doc_id": 11}')
    (path / "g.txt").write_text('{"doc_id": 12}')
    assert sorted(r.doc_id for r in tables.src_presentations(spark, str(path), DECKS).collect()) == [0, 1, 2, 3, 9, 9, 10, 10, 11]


def test_a_task_that_dies_half_way_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.sink_presentations(decks(spark, "old"), path)
    many = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.array(F.lit("c")).alias("cue_ids"), F.array(F.struct(F.when(F.col("id") == 3990, F.raise_error(F.lit("lost"))).otherwise(F.lit(1)).cast("int").alias("cue_no"), F.lit("x").alias("name"))).alias("cues"))
    for mode in ("overwrite", "append"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            tables.sink_presentations(many, path, mode)
        assert files(path) == ["old.pro"] and [r.doc_id for r in tables.src_presentations(spark, path, DECKS).collect()] == [0]


def test_cues_of_any_deck_as_a_table(spark, tmp_path):
    x = spark.range(50).select((F.col("id") % 3).alias("doc_id"), F.col("id").cast("int").alias("cue_no"))
    tables.sink_cues(x, str(tmp_path / "cues"))
    assert spark.read.parquet(str(tmp_path / "cues")).count() == 50


def test_rejects_are_parted_in_one_run(spark):
    docs = spark.createDataFrame([(1, "Title: x"), (2, " \n"), (3, "plain"), (4, None)], "doc_id bigint, text string")
    lines = tables.src_lines(docs)
    good, bad = outline.quarantine(docs, outline.entries(lines))
    assert [tuple(r) for r in good.collect()] == [(1, "Title: x")]
    assert sorted(tuple(r) for r in bad.collect()) == [(2, "no text found"), (3, "no labels found"), (4, "no text found")]
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id bigint, page int")
    good, bad = outline.page_quarantine(pages, pages.where("page = 1"))
    assert [tuple(r) for r in good.collect()] == [(1, 1)] and [tuple(r) for r in bad.collect()] == [(1, 2, "no text on this page")]
    plan = outline.tagged(docs, outline.entries(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def styles_of(spark, *rows):
    """(name, at, cue)"""
    x = spark.createDataFrame(list(rows), "name string, at int, cue string")
    settings = F.struct(F.lit("#FFFFFF").alias("regular_color"), F.lit(None).cast("string").alias("emphasis_color"), F.lit(None).cast("boolean").alias("force_caps_off"), F.lit(None).cast("boolean").alias("highlight_bold"), F.lit(None).cast("int").alias("scripture_max_lines"))
    return x.select("name", F.lit("slides").alias("kind"), F.create_map(F.lit("title"), F.encode("cue", "UTF-8")).alias("templates"), settings.alias("settings"), "at")


def held(df):
    return {r.name: bytes(r.templates["title"]).decode() for r in df.collect()}


def test_two_savers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "styles")
    a, b = store.StyleStore(spark, path), store.StyleStore(spark, path)
    assert held(a.load()) == {} and a.generations() == []
    assert a.save(styles_of(spark, ("One", 1, "old"), ("One", 2, "new"), ("Two", 1, "x")), "at") == 1
    publish, numbers = a.publish, []

    def late(generation, folders):
        """The other one saves between this one's reading and its publishing."""
        numbers.append(generation)
        if len(numbers) == 1:
            b.save(styles_of(spark, ("Three", 1, "b"), ("Two", 1, "b")), "at")
        return publish(generation, folders)

    a.publish = late
    assert a.save(styles_of(spark, ("One", 1, "a")), "at") == 3 and numbers == [2, 3]
    assert held(b.load()) == {"One": "a", "Two": "b", "Three": "b"} and b.generations() == [1, 2, 3]
    assert held(b.load(1)) == {"One": "new", "Two": "x"} and held(b.load(2)) == {"One": "new", "Two": "b", "Three": "b"}
    assert b.remove("Two") == 4 and sorted(held(a.load())) == ["One", "Three"]


def test_half_a_save_is_not_seen(spark, tmp_path):
    s = store.StyleStore(spark, str(tmp_path / "styles"))
    s.save(styles_of(spark, ("One", 1, "x")), "at")
    s.publish = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        s.save(styles_of(spark, ("One", 1, "y"), ("Two", 1, "y")), "at")
    again = store.StyleStore(spark, str(tmp_path / "styles"))
    assert held(again.load()) == {"One": "x"} and again.publish(1, {}) is False
