"""Toxicity by cumulative-link ordinal regression.

Severity has the grades 0 (clean), 1 (toxic) and 2 (toxic, and marked words are at least as dense as in the median toxic document).
All thresholds share one weight per feature: P(grade > k) = 1 / (1 + exp(t_k - w x)) with t_0 < t_1, and
the expected severity is the sum of these probabilities.  Features are words and beginnings of words, so that a
stem is known in forms that no labelled document has.

The model is fitted on a bounded number of labelled documents, those with the smallest hash of their id; features are counted by Spark,
the best of them make up the sparse design matrix.  Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.common import map_texts, text_of
from phasebeat.llm.wordnames import WordNames
from phasebeat.workspace import store

PREFIXES = (4, 5, 6, 7)
# Bounds of the fit: labelled documents, features, rounds.
LABELLED = 8000
FEATURES = 2048
ROUNDS = 800
# A feature must occur in so many toxic documents, and so many times as often in them.
SUPPORT = 3
RATIO = 8.0
RIDGE = 1e-4
TOXIC = 0.5


@dataclass(frozen=True)
class Model:
    """Names of the features in order, their weights, and the thresholds between the grades."""

    names: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def beyond(self, logits: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - logits[:, None], -500, 500)))


def features(text: str, names: WordNames) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and how often it has each per hundred words."""
    found, starts = names.of(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8), PREFIXES)
    distinct, counts = np.unique(found, return_counts=True)
    if len(distinct) and distinct[0] == 0:
        distinct, counts = distinct[1:], counts[1:]
    return distinct, counts * (100.0 / max(len(starts), 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``text, toxic`` of at most ``limit`` labelled ids, one row each, written once; of the texts of a repeated id the least counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(some), "doc_id")
    return store(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = WordNames()
    for batch in batches:
        parts: list[list[np.ndarray]] = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            parts[int(toxic.as_py() > 0)].append(features(text.as_py(), names)[0])
        for toxic, lists in enumerate(parts):
            distinct, counts = np.unique(np.concatenate(lists), return_counts=True)
            columns = [pa.array(distinct.view(np.int64)), pa.array(np.full(len(distinct), toxic, np.int32)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "n"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, n_features: int = FEATURES) -> Model | None:
    """The model, ``None`` without labels of both kinds.

    Labels with a null id or grade are left out, ids labelled twice count once with the higher label.
    """
    sample = labelled_sample(docs, labels, limit)
    totals = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    counted = map_texts(sample, _count, "feature long, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )
    ratio = (F.col("bad") + 0.5) / (totals[True] + 1) / ((F.col("good") + 0.5) / (totals[False] + 1))
    marked = counted.where(F.col("bad") >= SUPPORT).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
    best = marked.orderBy((F.col("bad") * F.log("ratio")).desc(), "feature").limit(n_features).select("feature").collect()
    known = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            found = [_known(t.as_py(), names, known) for t in batch["text"]]
            columns = [
                pa.array([int(x.as_py() > 0) for x in batch["toxic"]], pa.int32()),
                pa.array([f[0] for f in found], pa.list_(pa.int64())),
                pa.array([f[1] for f in found], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "at", "counts"])

    rows = map_texts(sample, design, "toxic int, at array<long>, counts array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["toxic"], r["at"], r["counts"]))  # at most ``limit``, in the same order each time
    sizes = [len(r["at"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    column = np.fromiter((x for r in rows for x in r["at"]), np.int64, sum(sizes))
    counts = np.fromiter((x for r in rows for x in r["counts"]), np.float64, sum(sizes))
    toxic = np.array([r["toxic"] for r in rows])
    hits = np.bincount(row, weights=counts, minlength=len(rows))
    grade = toxic * (1 + ((hits > 0) & (hits >= np.median(hits[toxic == 1]))))
    return Model(known, *_regress(row, column, np.log1p(counts), grade, len(known)))


def _known(text: str, names: WordNames, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the model's features a text has, and how often per hundred words."""
    found, counts = features(text, names)
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    hit = known[at] == found if len(known) else np.zeros(len(found), bool)
    return at[hit], counts[hit]


def _regress(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps with momentum estimates on the ordinal likelihood."""
    n = len(grade)
    top = max(int(grade.max()), 1)
    first = np.log((grade == 0).mean() / max((grade > 0).mean(), 1e-9) + 1e-9)
    theta = np.concatenate([np.zeros(n_features), [first], np.zeros(top - 1)])  # later thresholds as logarithms of steps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, base, gaps = theta[:n_features], theta[n_features], np.exp(theta[n_features + 1 :])
        cuts = np.concatenate([[base], base + np.cumsum(gaps)])
        logits = np.bincount(row, weights=weights[column] * value, minlength=n)
        s = 1 / (1 + np.exp(np.clip(cuts[None, :] - logits[:, None], -60, 60)))  # P(grade > k)
        edges = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        here = np.arange(n)
        p = np.maximum(edges[here, grade] - edges[here, grade + 1], 1e-12)
        slope = edges * (1 - edges)
        d_logit = (slope[here, grade] - slope[here, grade + 1]) / p
        d_cuts = np.zeros(top)
        for k in range(top):
            d_cuts[k] = (np.where(grade == k + 1, -slope[:, k + 1], 0) + np.where(grade == k, slope[:, k + 1], 0)) @ (1 / p)
        gradient = np.empty_like(theta)
        gradient[:n_features] = np.bincount(column, weights=value * d_logit[row], minlength=n_features) / n - RIDGE * weights
        gradient[n_features] = d_cuts.sum() / n
        for k in range(1, top):
            gradient[n_features + k] = d_cuts[k:].sum() * gaps[k - 1] / n
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:n_features], np.concatenate([[theta[n_features]], theta[n_features] + np.cumsum(np.exp(theta[n_features + 1 :]))])


SCORES = "p_toxic double, p_severe double, severity double, grade int, toxic boolean"


def _graded(texts: list[str], model: Model | None, names: WordNames) -> np.ndarray:
    """P(grade > k) of each text."""
    if model is None:
        return np.zeros((len(texts), 1))
    logits = np.zeros(len(texts))
    for k, text in enumerate(texts):
        at, counts = _known(text, names, model.names)
        logits[k] = model.weights[at] @ np.log1p(counts) if len(at) else 0.0
    return model.beyond(logits)


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, p_toxic, p_severe, severity, grade, toxic`` of every row.

    The probabilities of a grade over 0 and of the highest, the expected severity, the most likely grade, and whether
    ``p_toxic`` is a half or more.  Null and empty texts have no features, and without a model nothing is toxic.  Repeated rows
    are graded one by one, an empty table gives no rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            beyond = _graded(batch["text"].to_pylist(), model, names)
            p = np.concatenate([1 - beyond[:, :1], beyond[:, :-1] - beyond[:, 1:], beyond[:, -1:]], axis=1)
            columns = [beyond[:, 0], beyond[:, -1], beyond.sum(axis=1), p.argmax(axis=1).astype(np.int32), beyond[:, 0] >= TOXIC]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c) for c in columns]], ["doc_id", "p_toxic", "p_severe", "severity", "grade", "toxic"]
            )

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, of, f"doc_id {kind}, p_toxic double, p_severe double, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array(_graded(texts, model, names)[:, 0] < TOXIC))

    return map_texts(docs, of, docs.schema)
