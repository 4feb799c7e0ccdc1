"""Quality classifier: naive Bayes support vectors.

Indicators of word and word-shape n-grams are scaled by the log-count ratio of the two
classes, each row is brought to length one, and a linear hinge-loss model is fitted by
dual coordinate descent. A logistic curve fitted on rows left out of that fit turns
margins into scores.

Defined results: a null or empty text has no n-grams and gets the score of the intercept;
null labels are not learned from; equal texts get equal scores; an empty table gives an
empty result; without rows of both classes every score is the share of label 1 (0.5 if
there is none). Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, keep, mixed, pieces_of, text_bytes

BITS = 18
#: Most labelled rows that the fit looks at, in the order of a hash of their id.
MAX_TRAIN_ROWS = 12_000
THRESHOLD = 0.7
_SHARES = (0.02, 0.1, 0.3)


def indicator_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) pairs, each once, in order of the text.

    n-grams are: lower-cased words (1), word shapes (1-3) and, for shapes that make up
    over a given share of a text's words, a feature for each share passed. A shape says
    which classes of characters a word has, its first and last two bytes if these are not
    letters or digits, and whether the word repeats the one before.
    """
    docs, features = [], []
    for a, b in pieces_of(texts):
        raw = Words(texts[a:b])
        if not len(raw.doc):
            continue
        low = Words([t.lower() for t in texts[a:b]])
        d, data = raw.doc, raw.data
        upper = (data >= 65) & (data <= 90)
        lower = (data >= 97) & (data <= 122)
        digit = (data >= 48) & (data <= 57)
        wide = data >= 128
        other = ~(upper | lower | digit | wide)

        def some(mask: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(mask)])
            return (c[raw.end] > c[raw.start]).astype(np.uint64)

        last = np.where(other[raw.end - 1], data[raw.end - 1], 0).astype(np.uint64)
        before = np.where((raw.end - raw.start > 1) & other[raw.end - 2], data[np.maximum(raw.end - 2, 0)], 0).astype(np.uint64)
        first = np.where(other[raw.start], data[raw.start], 0).astype(np.uint64)
        same = np.concatenate([[False], (low.hash[1:] == low.hash[:-1]) & (d[1:] == d[:-1])]).astype(np.uint64)
        lone = ((raw.end - raw.start) <= 2).astype(np.uint64)
        shape = some(upper) | some(lower) << np.uint64(1) | some(digit) << np.uint64(2) | some(wide) << np.uint64(3)
        shape |= upper[raw.start].astype(np.uint64) << np.uint64(4) | same << np.uint64(5) | lone << np.uint64(6)
        shape = mixed(shape | first << np.uint64(8) | before << np.uint64(16) | last << np.uint64(24))
        in_two, in_three = d[1:] == d[:-1], d[2:] == d[:-2]
        two = (shape[:-1] * np.uint64(31) + shape[1:])[in_two]
        three = ((shape[:-2] * np.uint64(31) + shape[1:-1]) * np.uint64(31) + shape[2:])[in_three]
        count = np.bincount(d, minlength=b - a)
        kinds, index = np.unique(shape, return_inverse=True)
        cells, n = np.unique(d * len(kinds) + index, return_counts=True)
        share = n / count[cells // len(kinds)]
        parts = [(d, low.hash + np.uint64(1)), (d, shape + np.uint64(2)), (d[1:][in_two], mixed(two)), (d[2:][in_three], mixed(three))]
        parts += [(cells[share > s] // len(kinds), mixed(kinds[cells[share > s] % len(kinds)] + np.uint64(3 + i))) for i, s in enumerate(_SHARES)]
        key = np.unique(np.concatenate([(x.astype(np.uint64) << np.uint64(BITS)) | (mixed(h) >> np.uint64(64 - BITS)) for x, h in parts]))
        docs.append((key >> np.uint64(BITS)).astype(np.int64) + a)
        features.append((key & np.uint64((1 << BITS) - 1)).astype(np.int32))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(docs), np.concatenate(features)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = list(text_bytes(batch["text"]))
        doc, feature = indicator_features(texts)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature))
        yield pa.RecordBatch.from_arrays([batch["label"], batch["order"], lists], ["label", "order", "features"])


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss; feature ``dim`` is the intercept.

    One dual variable per row lies in [0, cost]; each step sets it to the best value with
    the others fixed. Rows have length one after scaling by ``values``.
    """
    w = np.zeros(dim + 1)
    alpha = np.zeros(len(rows))
    scaled = []
    for f in rows:
        x = values[f]
        norm = np.sqrt((x * x).sum())
        scaled.append(x / norm if norm else x)
    square = np.array([(x * x).sum() for x in scaled]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x = rows[i], scaled[i]
            gradient = y[i] * (w[f] @ x + w[dim]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                w[dim] += step
                alpha[i] = new
    return w


def logistic_curve(margin: np.ndarray, target: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    n1, n0 = target.sum(), (1 - target).sum()
    t = np.where(target > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, rows, order = [], [], []
    for batch in batches:
        ends = batch["features"].offsets.to_numpy()
        flat = batch["features"].values.to_numpy()
        rows += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        labels += batch["label"].to_pylist()
        order += batch["order"].to_pylist()
    dim = 1 << BITS
    place = np.argsort(np.array(order, np.int64), kind="stable") if order else []
    rows, target = [rows[i] for i in place], np.array([labels[i] for i in place], np.float64)
    w, a, b = np.zeros(dim + 1), 1.0, 0.0
    if 0 < target.sum() < len(target):
        held = np.arange(len(target)) % 4 == 3
        if not 0 < target[held].sum() < held.sum() or not 0 < target[~held].sum() < (~held).sum():
            held[:] = False
        use = np.flatnonzero(~held)
        one, zero = np.ones(dim), np.ones(dim)
        for i in use:
            (one if target[i] else zero)[rows[i]] += 1
        ratio = np.log((one / one.sum()) / (zero / zero.sum()))
        y = np.where(target[use] > 0, 1.0, -1.0)
        cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
        w = dual_coordinate_descent([rows[i] for i in use], ratio, y, cost, dim)
        out = np.flatnonzero(held) if held.any() else use
        margin = np.array([_margin(rows[i], ratio, w) for i in out])
        a, b = logistic_curve(margin, target[out])
        weight = np.concatenate([w[:dim] * ratio, [w[dim], a, b]])
        length = np.concatenate([ratio, [0, 0, 0]])
    else:
        share = target.mean() if len(target) else 0.5
        b = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        weight, length = np.concatenate([w, [a, b]]), np.zeros(dim + 3)
    some = np.union1d(np.flatnonzero(weight), np.flatnonzero(length))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(weight[some]), pa.array(length[some])], ["at", "weight", "ratio"])


def _margin(f: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> float:
    x = ratio[f]
    norm = np.sqrt((x * x).sum()) or 1.0
    return float(w[f] @ x / norm + w[-1])


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Fit on docs(doc_id, text) and labels(doc_id, label); at most ``max_train_rows`` labels, chosen by a hash of the id.

    The chosen ids, of bounded number, are sent to the documents, which are not shuffled.
    Their features are made by all tasks; the descent, which is sequential, runs in one
    task over that bounded sample. The model has at most 2**18 weights.
    """
    ids = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("order")).distinct().orderBy("order", "doc_id", "label").limit(max_train_rows)
    train_rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    features = train_rows.select("label", "order", "text").mapInArrow(_feature_rows, "label int, order long, features array<int>")
    # repeated ids give more rows than ids: bounded again, by rows
    model = keep(features).orderBy("order", "label").limit(max_train_rows).repartition(1).mapInArrow(_fit, "at long, weight double, ratio double")
    got = model.toPandas()
    weight, ratio = np.zeros((1 << BITS) + 3), np.zeros((1 << BITS) + 3)
    weight[got["at"]], ratio[got["at"]] = got["weight"], got["ratio"]
    return {"weight": weight.astype(np.float32), "square": (ratio * ratio).astype(np.float32)}


def score(docs: DataFrame, model: dict[str, np.ndarray], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of docs and ``score``, from the whole ``text``; the model is broadcast (2 MB)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, square = sent.value["weight"], sent.value["square"]
        bias, a, b = (float(x) for x in weight[-3:])
        for batch in batches:
            texts = list(text_bytes(batch["text"]))
            doc, f = indicator_features(texts)
            n = len(texts)
            norm = np.sqrt(np.bincount(doc, square[f], n))
            margin = np.bincount(doc, weight[f], n) / np.where(norm > 0, norm, 1) + bias
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(p)], [*columns, "score"])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(scored, schema)
