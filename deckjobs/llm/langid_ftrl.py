"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader with elastic-net penalties, then one
temperature is fitted on rows left out. Characters are lower-cased code points; n-grams of
one to three are hashed.

Defined results: a null text, or one without any letter, is ``und`` with score 1; equal
texts get equal results; rows with a null ``lang`` are not learned from; with nothing to
learn from every text is ``und`` with score 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lean

BITS = 14
#: Most labelled rows that the fit looks at, in the order of a hash of their id.
MAX_TRAIN_ROWS = 6_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 16
# fixed values: odd multipliers of the n-gram hash
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    total = None
    low = text.lower()
    for i in range(0, len(low), _BLOCK):
        code = np.frombuffer(low[i : i + _BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = min(len(code), _BLOCK)
        two = code[:-1][:n] * _M1 + code[1:][:n] * _M2
        three = two[: max(len(code) - 2, 0)] + code[2:][: len(two)] * _M3
        g = np.concatenate([code[:n] * _M1, two, three])
        g ^= g >> np.uint64(29)
        g *= _M2
        g >>= np.uint64(64 - BITS)
        counts = np.bincount(g.view(np.int64), minlength=1 << BITS)
        total = counts if total is None else total + counts
    return total


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            c = gram_counts(text)
            if c is not None:
                seen += c > 0
                n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["at", "n"])


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, dim: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 11) -> np.ndarray:
    """FTRL-proximal for softmax loss; the last feature is the intercept, without penalty by l1."""
    z, n = np.zeros((dim + 1, k)), np.zeros((dim + 1, k))
    free = np.full(dim + 1, l1)
    free[dim] = 0
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        p = free[at][:, None]
        return np.where(np.abs(zz) <= p, 0, -(zz - np.sign(zz) * p) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], dim), np.append(rows[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dim + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood (grid, then golden section)."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    best = int(np.argmin([loss(t) for t in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 60)]
    for _ in range(40):
        c, d = b - 0.618 * (b - a), a + 0.618 * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float((a + b) / 2)


def train(rows: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> dict:
    """Fit on rows(doc_id, text, lang). Document frequencies cover all rows; the sequential descent a bounded sample.

    The model has 2**14 weights for each language.
    """
    rows = rows.where("lang is not null")
    counted = rows.select("text").mapInArrow(lean(_document_frequency), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n_docs = int(counted.loc[counted["at"] == -1, "n"].sum())
    df = np.zeros(1 << BITS)
    df[counted.loc[counted["at"] >= 0, "at"]] = counted.loc[counted["at"] >= 0, "n"]
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    sample = rows.select("doc_id", F.xxhash64("doc_id").alias("order")).distinct().orderBy("order", "doc_id").limit(max_train_rows)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, xs = [], []
            for text in batch["text"].to_pylist():
                c = gram_counts(text)
                at, x = _vector(c, sent.value) if c is not None else (np.zeros(0, np.int64), np.zeros(0))
                ats.append(at.astype(np.int32))
                xs.append(x.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch["order"], batch["lang"], pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))], ["order", "lang", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, lang, data = [], [], []
        for batch in batches:
            order += batch["order"].to_pylist()
            lang += batch["lang"].to_pylist()
            ends, at, x = batch["at"].offsets.to_numpy(), batch["at"].values.to_numpy(), batch["x"].values.to_numpy()
            data += [(at[a:b], x[a:b].astype(np.float64)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        some = [i for i in sorted(range(len(order)), key=lambda i: order[i]) if len(data[i][0])]
        names = sorted({lang[i] for i in some})
        if not names:
            return
        y = np.array([names.index(lang[i]) for i in some])
        held = np.arange(len(some)) % 5 == 4
        use = np.flatnonzero(~held)
        w = follow_the_leader([data[some[i]] for i in use], y[use], len(names), 1 << BITS)
        out = np.flatnonzero(held) if held.any() else use
        logits = np.array([data[some[i]][1] @ w[data[some[i]][0]] + w[-1] for i in out])
        t = temperature(logits, y[out])
        for k, name in enumerate(names):
            at = np.flatnonzero(w[:, k])
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(w[at, k], t))], ["lang", "at", "w"])

    made = rows.select("doc_id", "lang", "text").join(F.broadcast(sample), "doc_id").select("order", "lang", "text").mapInArrow(lean(vectors), "order long, lang string, at array<int>, x array<float>")
    # repeated ids give more rows than ids: bounded again, by rows
    got = keep(made).orderBy("order", "lang").limit(max_train_rows).repartition(1).mapInArrow(lean(fit), "lang string, at long, w double").toPandas()
    names = sorted(got["lang"].unique())
    w = np.zeros(((1 << BITS) + 1, len(names)))
    t = 1.0
    for k, name in enumerate(names):
        own = got[(got["lang"] == name) & (got["at"] >= 0)]
        w[own["at"], k] = own["w"]
        t = float(got.loc[(got["lang"] == name) & (got["at"] == -1), "w"].iloc[0])
    return {"names": names, "w": w.astype(np.float32), "idf": idf.astype(np.float32), "t": t}


def predict(docs: DataFrame, model: dict, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of docs with ``lang_pred`` and ``score`` (calibrated probability), from the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, idf, t = (sent.value[k] for k in ("names", "w", "idf", "t"))
        for batch in batches:
            lang, p = [], []
            for text in batch["text"].to_pylist():
                c = gram_counts(text)
                if c is None or not names:
                    lang.append(UNKNOWN)
                    p.append(1.0 if names else 0.0)
                    continue
                at, x = _vector(c, idf)
                s = (x @ w[at] + w[-1]).astype(np.float64) / t
                e = np.exp(s - s.max())
                best = int(np.argmax(s))
                lang.append(names[best])
                p.append(float(e[best] / e.sum()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*columns, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(lean(predicted), schema)
