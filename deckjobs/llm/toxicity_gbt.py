"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (words, and word beginnings, that the
labelled rows show to be typical of label 1), nearness of lexicon words to second-person
words, capitals, punctuation and obfuscated spellings. Trees and calibration are Spark ML's;
feature extraction runs once over all rows, in Arrow batches.

Defined results: null or empty texts have all features zero and a score like any other;
null labels are not learned from; equal texts get equal scores; an empty table gives an
empty result; without rows of both classes every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, keep, pieces_of, shuffle_width, text_bytes

#: Most labelled rows from which the lexicon is learned, in the order of a hash of their id.
MAX_LEXICON_ROWS = 12_000
#: Most entries of the lexicon.
LEXICON_SIZE = 4096
#: Least number of texts of label 1 with an entry, and least log odds of it.
LEAST_TEXTS, LEAST_ODDS = 5, 3.0
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
NEAR = 5
# fixed values: second-person words (English, German, French, Spanish)
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros", "tus")
FEATURES = ("hits", "hit_density", "begin_hits", "begin_density", "odds_sum", "odds_density", "near_second", "second_density", "capitals", "capital_words", "punctuation", "shouting", "obfuscated", "mean_length")


class _Terms:
    """Words of some texts without surrounding punctuation, and the hashes of their beginnings."""

    def __init__(self, texts: list[bytes]):
        self.raw = raw = Words(texts)
        self.low = Words.SPACE  # replaced below when there are words
        data = raw.data
        self.upper = (data >= 65) & (data <= 90)
        self.lower = (data >= 97) & (data <= 122)
        self.digit = (data >= 48) & (data <= 57)
        self.other = ~(self.upper | self.lower | self.digit | (data >= 128) | Words.SPACE[data])
        start, end = raw.start.copy(), raw.end.copy()
        for _ in range(4):
            if len(start):
                start += (start < end - 1) & self.other[start]
                end -= (start < end - 1) & self.other[end - 1]
        self.start, self.end = start, end
        low = data + np.where(self.upper, 32, 0).astype(np.uint8)
        self.word = Words.span_hash(low, start, end)
        length = end - start
        self.begin = [np.where(length > p, Words.span_hash(low, start, np.minimum(start + p, end)) + np.uint64(p), np.uint64(0)) for p in PREFIXES]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, label = list(text_bytes(batch["text"])), batch["label"].to_numpy()
        terms, ones = [], []
        for a, b in pieces_of(texts):
            t = _Terms(texts[a:b])
            if not len(t.word):
                continue
            for h in (t.word, *t.begin):
                order = np.lexsort((h, t.raw.doc))
                hs, ds = h[order], t.raw.doc[order]
                new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) & (hs != 0)
                terms.append(hs[new])
                ones.append(label[ds[new] + a])
        if terms:
            h, at = np.unique(np.concatenate(terms), return_inverse=True)
            toxic = np.concatenate(ones)
            n1 = np.bincount(at, toxic, len(h)).astype(np.int64)
            n0 = np.bincount(at, 1 - toxic, len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n1), pa.array(n0)], ["term", "n1", "n0"])


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LEXICON_ROWS, size: int = LEXICON_SIZE) -> dict[int, float]:
    """Hash of a term -> its log odds, from docs(doc_id, text) and labels(doc_id, label); at most ``size`` entries.

    At most ``max_rows`` labels, chosen by a hash of the id, are sent to the documents.
    """
    ids = labels.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    total = ids.groupBy().agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    n1, n0 = total["n1"] or 0, total["n0"] or 0
    if not n1 or not n0:
        return {}
    odds = F.log((F.col("n1") + 0.1) / F.lit(n1 + 0.2)) - F.log((F.col("n0") + 0.1) / F.lit(n0 + 0.2))
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .select("label", "text")
        .mapInArrow(_term_counts, "term long, n1 long, n0 long")
        .where("n1 > 0 or n0 > 0")
        .groupBy("term")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where(F.col("n1") >= LEAST_TEXTS)
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.log1p("n1")), "term")
        .limit(size)
    )
    return {r["term"]: r["odds"] for r in found.select("term", "odds").collect()}


def _shares(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)


def features(docs: DataFrame, lexicon: dict[int, float], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and ``features array<double>`` of every whole text."""
    keys = np.array(sorted(lexicon), np.int64).view(np.uint64)
    keys = np.sort(keys)
    odds = np.array([lexicon[int(np.uint64(k).astype(np.int64))] for k in keys])
    sent = docs.sparkSession.sparkContext.broadcast((keys, odds))
    schema = docs.select(*columns).schema.add("features", T.ArrayType(T.DoubleType()))

    def found(h: np.ndarray) -> np.ndarray:
        k, o = sent.value
        if not len(k):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(k, h), len(k) - 1)
        return np.where(k[at] == h, o[at], 0.0)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = np.sort(np.array([_Terms([w.encode()]).word[0] for w in SECOND_PERSON]))
        for batch in batches:
            texts = list(text_bytes(batch["text"]))
            out = np.zeros((len(texts), len(FEATURES)))
            for a, b in pieces_of(texts):
                t = _Terms(texts[a:b])
                if not len(t.word):
                    continue
                n, d = b - a, t.raw.doc
                words = np.maximum(np.bincount(d, minlength=n), 1)
                hit = found(t.word)
                begin = np.max([found(h) for h in t.begin], axis=0)
                best = np.maximum(hit, begin)
                at = np.minimum(np.searchsorted(second, t.word), len(second) - 1)
                you = second[at] == t.word
                places = np.flatnonzero(you)
                near = np.zeros(len(d), bool)
                if len(places):
                    i = np.arange(len(d))
                    j = np.clip(np.searchsorted(places, i), 0, len(places) - 1)
                    for p in (places[j], places[np.maximum(j - 1, 0)]):
                        near |= (np.abs(p - i) <= NEAR) & (d[p] == d)
                near &= best > 0

                def per_word(mask: np.ndarray) -> np.ndarray:
                    c = np.concatenate([[0], np.cumsum(mask)])
                    return c[t.end] - c[t.start]

                length = t.end - t.start
                ups, lows, digits, others = (per_word(m) for m in (t.upper, t.lower, t.digit, t.other))
                letters = np.maximum(np.bincount(d, ups + lows, n), 1)
                size = np.maximum(np.bincount(d, t.raw.end - t.raw.start, n), 1)
                odd = ((digits > 0) & (lows + ups > 0)) | ((others > 0) & (lows + ups > 1) & (length > 2))
                shout = np.isin(t.raw.data[t.raw.end - 1], (33, 63))
                outer = (t.raw.end - t.raw.start) - length + others
                out[a:b] = np.stack(
                    [np.log1p(_shares(hit > 0, d, n)), _shares(hit > 0, d, n) / words, np.log1p(_shares(begin > 0, d, n)), _shares(begin > 0, d, n) / words, np.log1p(_shares(best, d, n)), _shares(best, d, n) / words, np.log1p(_shares(near, d, n)), _shares(you, d, n) / words]
                    + [np.bincount(d, ups, n) / letters, _shares((ups > 1) & (lows == 0), d, n) / words, np.bincount(d, outer, n) / size, _shares(shout, d, n) / words, _shares(odd, d, n) / words, np.bincount(d, length, n) / words],
                    axis=1,
                )
            ends = np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], [*columns, "features"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(made, schema)


def train_and_score(docs: DataFrame, labelled: DataFrame, trees: int = 20, depth: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score). ``labelled(doc_id, label)`` are the rows to learn from.

    The labelled rows are split by a hash of the id: one part gives the lexicon, one the
    trees, one the calibration, so that none is fitted on what another has memorised. The
    feature table, a few numbers a document, is written once and read by all later steps.
    """
    spark = docs.sparkSession
    labelled = labelled.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(8))
    labelled = keep(labelled.withColumn("part", part))
    lexicon = learn_lexicon(docs, labelled.where("part < 4"))
    table = keep(features(docs, lexicon))
    vectors = table.withColumn("features", array_to_vector("features"))
    use = vectors.join(labelled.where("part >= 4"), "doc_id").select("features", F.col("label").cast("double").alias("label"), "part").coalesce(shuffle_width(spark))
    grow, hold = use.where("part < 7"), use.where("part = 7")
    n = {r["label"]: r["count"] for r in grow.groupBy("label").count().collect()}
    if len(n) < 2:
        share = labelled.agg(F.avg("label")).first()[0]
        return table.select("doc_id", F.lit(0.5 if share is None else float(share)).alias("score"))
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, maxBins=64, checkpointInterval=-1).fit(grow)
    chance = vector_to_array("probability")[1]
    held = boosted.transform(hold).select(F.col("label"), chance.alias("raw"))
    first = held.groupBy("label").count().count()
    out = boosted.transform(vectors).select("doc_id", chance.alias("raw"))
    if first < 2:
        return out.select("doc_id", F.col("raw").alias("score"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held)
    return curve.transform(out).select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
