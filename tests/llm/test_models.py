"""Trained operators: held-out accuracy on the smallest tables, and defined results at the edges."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckjobs.llm import langid_ftrl, quality_nbsvm, queries, toxicity_gbt

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n", None), (4, "123 !!", "de"), (5, "Hello there my friends", "en"), (6, "Hello there my friends", "en"), (None, "Guten Tag und auf Wiedersehen", "de"), (7, "wort " * 40_000, "de"), (8, "Bonjour à tous", "fr")]


def odd(spark):
    return spark.createDataFrame([(*r, 1, 0.5) for r in ODD], "doc_id bigint, text string, lang string, label int, score double")


@needs_data
def test_quality_held_out(spark):
    got = queries.op1_quality_nbsvm(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    x = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert x.where("predicted = quality").count() / x.count() > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())


@needs_data
def test_language_held_out(spark):
    got = queries.op5_langid_ftrl(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.95


@needs_data
def test_toxicity_held_out(spark):
    x = queries.op9_toxicity_gbt(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert x.where("predicted = toxic").count() / x.count() > 0.9
    assert x.where("score < 0 or score > 1 or score is null").count() == 0


def test_edges_of_quality(spark):
    docs = odd(spark)
    nothing = quality_nbsvm.train(docs, docs.select("doc_id", "label").limit(0))
    assert all(r.score == pytest.approx(0.5) for r in quality_nbsvm.score(docs, nothing).collect())
    model = quality_nbsvm.train(docs, spark.createDataFrame([(5, 1), (8, 0), (2, 0), (1, None)], "doc_id bigint, label int"))
    got = {r.doc_id: r.score for r in quality_nbsvm.score(docs, model).collect()}
    assert len(got) == len(ODD) and got[5] == got[6] > got[8] and got[1] == got[2]
    assert quality_nbsvm.score(docs.limit(0), model).count() == 0


def test_edges_of_language(spark):
    docs = odd(spark)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid_ftrl.predict(docs, langid_ftrl.train(docs)).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ("und", 1.0) and got[5] == got[6] and got[5][0] == "en"
    none = langid_ftrl.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid_ftrl.predict(docs.where("doc_id = 5"), none).collect()} == {("und", 0.0)}


def test_edges_of_toxicity(spark):
    docs = odd(spark)
    labels = docs.select("doc_id", "label")
    assert {r.score for r in toxicity_gbt.train_and_score(docs, labels).collect()} == {1.0}
    assert {r.score for r in toxicity_gbt.train_and_score(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity_gbt.train_and_score(docs.limit(0), labels).count() == 0


def test_toxicity_features(spark):
    docs = spark.createDataFrame([(1, "You are an IDIOT!! really"), (2, "calm words"), (3, None)], "doc_id bigint, text string")
    word = int(np.uint64(toxicity_gbt._Terms([b"idiot"]).word[0]).astype(np.int64))
    got = {r.doc_id: dict(zip(toxicity_gbt.FEATURES, r.features)) for r in toxicity_gbt.features(docs, {word: 5.0}).collect()}
    assert got[1]["hits"] > 0 and got[1]["near_second"] > 0 and got[1]["capital_words"] == 0.2 and got[1]["shouting"] == 0.2
    assert got[2]["hits"] == 0 and set(got[3].values()) == {0.0}


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    rows = [np.array([i % 2, 2 + rng.integers(0, 20)]) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w = quality_nbsvm.dual_coordinate_descent(rows, np.ones(22), y, np.ones(200), 22)
    assert all((w[r].sum() / np.sqrt(2) + w[22]) * t > 0 for r, t in zip(rows, y))


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = (p.cumsum(1) < rng.random((4000, 1))).sum(1)
    assert abs(langid_ftrl.temperature(logits * 5, y) - 5) < 0.7


def test_hidden_columns_do_not_clash(spark):
    docs = odd(spark).withColumn("features", F.lit(1)).withColumn("raw", F.lit(2)).withColumn("part", F.lit(3))
    assert toxicity_gbt.train_and_score(docs, docs.select("doc_id", "label")).count() == len(ODD)
