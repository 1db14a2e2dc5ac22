"""Toxicity by a chain of linear classifiers.

The categories are predicted in a given order. Each has a logistic model with an L1 penalty over the words and word beginnings of the text
(presence, weighted by rarity) and over the probabilities of the categories before it. While the chain is trained these probabilities are out-of-fold
predictions, so a later model sees them as uncertain as they will be on new texts. The models are fitted in numpy on a
bounded sample of labelled rows; every document is scored in its scan task, whole, without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opinaria.llm.common import as_bytes, hash_sample
from opinaria.llm.decontaminate import words_of
from opinaria.session import cut_lineage


SCORED = 256  # documents whose features are held together
STEMS = (4, 6)  # bytes of a word's beginnings


def features_of(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct words and word beginnings (compounds share the beginning of a slur)."""
    words = set(words_of(text))
    words |= {w[:k] + b"-" for w in words for k in STEMS if len(w) > k}
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


@dataclass
class Rows:
    """Sparse training rows: for each stored cell its row and feature number."""

    row: np.ndarray
    feature: np.ndarray
    n: int
    width: int

    def take(self, keep: np.ndarray) -> Rows:
        number = (np.cumsum(keep) - 1).astype(np.int32)
        inside = keep[self.row]
        return Rows(number[self.row[inside]], self.feature[inside], int(keep.sum()), self.width)


@dataclass
class Linear:
    """Logistic model: word weights by feature number, weights of earlier probabilities, intercept."""

    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(rows.row, self.weights[rows.feature], rows.n) + earlier @ self.chained + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray, selected: int = 2000, min_rows: int = 5, l1: float = 1e-3, rounds: int = 120) -> Linear:
    """Accelerated proximal gradient on the ``selected`` words most associated with the label. One class alone gives a constant."""
    weights, chained = np.zeros(rows.width), np.zeros(earlier.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Linear(weights, chained, bias if len(y) else -30.0)
    have = np.bincount(rows.feature, minlength=rows.width)
    positive = np.bincount(rows.feature, y[rows.row], rows.width)
    strength = np.where(have >= min_rows, np.abs(positive - have * y.mean()) / np.sqrt(np.maximum(have, 1)), 0)
    chosen = np.argsort(-strength, kind="stable")[:selected]
    chosen = chosen[strength[chosen] > 0]
    rarity = np.log((1 + len(y)) / (1 + have[chosen]))
    number = np.full(rows.width, -1)
    number[chosen] = np.arange(len(chosen))
    inside = number[rows.feature] >= 0
    r, f = rows.row[inside], number[rows.feature[inside]]
    value = rarity[f]
    n, k = len(y), len(chosen)
    w, momentum = np.zeros(k + earlier.shape[1] + 1), np.zeros(k + earlier.shape[1] + 1)
    w[-1] = momentum[-1] = bias
    dot = lambda v: np.bincount(r, value * v[f], n) + earlier @ v[k:-1] + v[-1]
    back = lambda e: np.concatenate([np.bincount(f, value * e[r], k), e @ earlier, [e.sum()]]) / n
    v = np.ones(len(w))
    for _ in range(8):  # largest eigenvalue by power iteration
        v = back(dot(v))
        v /= np.linalg.norm(v)
    step, t = 1 / (0.25 * np.linalg.norm(back(dot(v))) * 1.1 + 1e-9), 1.0
    penalty = np.concatenate([np.full(k, l1), np.zeros(earlier.shape[1] + 1)]) * step
    for _ in range(rounds):
        moved = momentum - step * back(1 / (1 + np.exp(-np.clip(dot(momentum), -30, 30))) - y)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        momentum, w = moved + (last - 1) / t * (moved - w), moved
    weights[chosen] = w[:k] * rarity
    return Linear(weights, w[k:-1], float(w[-1]))


def best_threshold(y: np.ndarray, p: np.ndarray, beta: float = 0.5) -> float:
    """The probability from which calling a row positive gives the best F-score, precision counting more than recall, but
    at least 0.5: few labelled rows must not make a rule that rejects clean texts. 0.5 when a class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f = (1 + beta**2) * hits / (np.arange(1, len(y) + 1) + beta**2 * y.sum())
    last_of_value = np.append(p[order][1:] < p[order][:-1], True)
    k = int(np.argmax(np.where(last_of_value, f, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return max(0.5, float((p[order][k] + below) / 2))


@dataclass
class Chain:
    """The fitted chain: sorted hashes of the words in use, a model and a threshold per category."""

    categories: list[str]
    words: np.ndarray
    models: list[Linear]
    thresholds: list[float]

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """Probabilities (row, category)."""
        n = len(features)
        flat = np.concatenate(features) if n else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(n), [len(x) for x in features])
        at = np.minimum(np.searchsorted(self.words, flat), max(len(self.words) - 1, 0))
        known = self.words[at] == flat if len(self.words) else np.zeros(len(flat), bool)
        rows = Rows(row[known], at[known], n, len(self.words))
        out = np.zeros((n, len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.predict(rows, out[:, :k])
        return out


def fit_chain(words: np.ndarray, rows: Rows, labels: np.ndarray, fold: np.ndarray, categories: list[str], folds: int, min_rows: int = 5) -> Chain:
    """``words`` are the sorted hashes of the features of ``rows``; ``labels`` (row, category) with nan where unknown; ``fold`` assigns rows to folds."""
    earlier = np.zeros((rows.n, 0))
    models, thresholds = [], []
    for k in range(len(categories)):
        y = labels[:, k]
        known = ~np.isnan(y)
        out_of_fold = np.zeros(rows.n)
        for part in range(folds):
            train = known & (fold != part)
            model = fit_linear(rows.take(train), earlier[train], y[train], min_rows=min_rows)
            test = fold == part
            out_of_fold[test] = model.predict(rows.take(test), earlier[test])
        models.append(fit_linear(rows.take(known), earlier[known], y[known], min_rows=min_rows))
        thresholds.append(best_threshold(y[known], out_of_fold[known]))
        earlier = np.column_stack([earlier, out_of_fold])
    used = np.any([m.weights != 0 for m in models], axis=0) if models else np.zeros(0, bool)
    return Chain(categories, words[used], [Linear(m.weights[used], m.chained, m.bias) for m in models], thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 20_000, folds: int = 5,
          min_rows: int = 5, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> Chain:
    """Fit the chain on at most ``max_rows`` labelled documents, those with the smallest hashes of their id.

    Features that fewer than ``min_rows`` of them hold are in no model, so they are counted out first; only the numbers of the others in these
    documents reach the driver. Repeated label rows of one document count once (the largest
    labels); unlabelled categories of a row are left out of that category's model.
    """
    marks = labels.where(F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("_id")).agg(
        *[F.max(F.col(c).cast("double")).alias(f"_y{k}") for k, c in enumerate(categories)])
    sample = hash_sample(marks, "_id", max_rows, marks.count())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [features_of(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.list_(pa.int64())), *batch.columns[2:]], names=["id", "words", *batch.schema.names[2:]])

    ys = [f"_y{k}" for k in range(len(categories))]
    labelled = ", ".join(f"{y} double" for y in ys)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), as_bytes(text_col).alias("_text"))
    found = cut_lineage(texts.join(F.broadcast(sample), "_id").select("_id", "_text", *ys).mapInArrow(hashed, f"id long, words array<long>, {labelled}"))
    frequent = found.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= min_rows).select("word").toArrow()
    words = np.sort(frequent["word"].to_numpy().view(np.uint64))
    del frequent
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            cells = []
            for row in batch.column(1):
                x = row.values.to_numpy().view(np.uint64)
                at = np.searchsorted(known, x)
                inside = at < len(known)
                inside[inside] = known[at[inside]] == x[inside]
                cells.append(at[inside].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), *batch.columns[2:]], names=batch.schema.names)

    got = found.mapInArrow(numbered, f"id long, words binary, {labelled}").toArrow().sort_by("id")
    y = np.column_stack([got[c].to_numpy() for c in ys]) if len(got) else np.zeros((0, len(categories)))
    fold = np.array([xxhash.xxh3_64_intdigest(str(i)) % folds for i in got["id"].to_pylist()], np.int64)
    features = [np.frombuffer(w.as_buffer(), np.int32) for w in got["words"]]
    row = np.repeat(np.arange(len(features), dtype=np.int32), [len(x) for x in features])
    rows = Rows(row, np.concatenate(features) if features else np.zeros(0, np.int32), len(features), len(words))
    del got, features
    return fit_chain(words, rows, y.astype(float), fold, categories, folds, min_rows)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with one double ``p_<category>`` per category and ``is_<category>`` (at least the category's threshold).

    A null or empty text has no words and gets the models' intercepts. All rows and columns stay; a column of ``docs`` with one of the new
    names is replaced.
    """
    new = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(*kept)
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, SCORED):
                part = batch.slice(first, SCORED)
                p = model.scores([features_of(t.as_py().encode() if t.is_valid else None) for t in part.column(at)])
                flags = [pa.array(p[:, k] >= t) for k, t in enumerate(model.thresholds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in p.T], *flags], names=[*kept, *new])

    fields = StructType(list(source.schema.fields))
    for name in new:
        fields = fields.add(name, "double" if name.startswith("p_") else "boolean")
    return source.mapInArrow(run, fields)
