"""Quality classifier by a sparse rule ensemble.

Boosted trees of small depth over statistics of the text are taken apart into their paths: every path is a conjunction of
thresholds.  A logistic model with a lasso penalty weighs these rules, most get none, and the rest is compiled into one
Spark column expression.  Statistics are built-in functions, so scoring runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.common import WORD, text_of
from phasebeat.workspace import store

# Bounds of the fit: labelled texts, trees, depth, thresholds tried per statistic, rules kept.
LABELLED = 8000
TREES = 40
DEPTH = 3
CUTS = 32
RULES = 200
THRESHOLD = 0.3
BLANKS = " \t\n\x0b\x0c\r"

STATISTICS = (
    "n_words",
    "mean_word",
    "symbols",
    "marks",
    "digits",
    "upper",
    "commas",
    "distinct_words",
    "same_as_last",
    "dup_lines",
    "words_per_line",
    "short_words",
)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Statistics of each text, ratios but for the number of words; an empty text has zeros."""

    def count(text: Column, characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))

    text = F.col("text")
    rows = docs.select(*keep, text_of(docs).alias("text"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)

    def same_as_last(w: Column) -> Column:
        return F.size(F.filter(w, lambda x, k: F.coalesce(F.get(w, k - 1) == x, F.lit(False))))

    def over_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n"),
            F.size(F.array_distinct(w)).alias("distinct"),
            same_as_last(w).alias("same"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("short"),
        )

    def over_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    # A transform over a one-element array computes its argument once.
    w = F.element_at(F.transform(F.array(words), over_words), 1)
    x = F.element_at(F.transform(F.array(lines), over_lines), 1)
    letters = F.length(F.translate(text, BLANKS, "")).alias("chars")
    counts = {
        "symbols": count(text, "#*$%&|<>"),
        "marks": count(text, "!?"),
        "digits": count(text, "0123456789"),
        "upper": count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "commas": count(text, ",."),
    }
    raw = rows.select(*keep, w.alias("w"), x.alias("x"), letters, *[c.alias(n) for n, c in counts.items()])
    n = F.greatest(F.col("w.n"), F.lit(1))
    n_lines = F.greatest(F.col("x.n"), F.lit(1))
    done = {
        "n_words": F.col("w.n").cast("double"),
        "mean_word": F.col("chars") / n,
        "distinct_words": F.col("w.distinct") / n,
        "same_as_last": F.col("w.same") / n,
        "dup_lines": F.col("x.dup") / n_lines,
        "words_per_line": F.col("w.n") / n_lines,
        "short_words": F.col("w.short") / n,
    } | {c: F.col(c) / n for c in counts}
    return raw.select(*keep, *[done[s].alias(s) for s in STATISTICS])


Condition = tuple[int, bool, float]  # statistic, above, threshold


@dataclass(frozen=True)
class Model:
    """Rules, each a tuple of conditions, their weights, and the intercept."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics."""
        logit = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for statistic, above, cut in rule:
                value = F.col(STATISTICS[statistic])
                holds = holds & (value > cut if above else value <= cut)
            logit = logit + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def _tree(x: np.ndarray, residual: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Paths to all nodes of a tree grown on gradients, and what its leaves add to the logit."""
    paths: list[tuple[Condition, ...]] = []
    step = np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        g, h = residual[rows], curve[rows]
        best = (1e-6, -1, 0.0)
        if len(path) < depth and len(rows) >= 40:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                slot = np.searchsorted(edges, x[rows, f], side="left")
                gs = np.cumsum(np.bincount(slot, weights=g, minlength=len(edges) + 1))[:-1]
                hs = np.cumsum(np.bincount(slot, weights=h, minlength=len(edges) + 1))[:-1]
                ns = np.cumsum(np.bincount(slot, minlength=len(edges) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < 15) | (len(rows) - ns < 15)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(edges[k]))
        if best[1] < 0:
            step[rows] = g.sum() / (h.sum() + 1)
            return
        below = x[rows, best[1]] <= best[2]
        grow(rows[below], (*path, (best[1], False, best[2])))
        grow(rows[~below], (*path, (best[1], True, best[2])))

    grow(np.arange(len(x)), ())
    return paths, step


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for f, above, cut in rule:
        held &= x[:, f] > cut if above else x[:, f] <= cut
    return held


def fit_rules(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees, their paths as rules, and lasso weights by proximal steps with momentum."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    logit, found = np.full(len(y), base), {}
    rng = np.random.default_rng(3)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        drawn = rng.random(len(y)) < 0.7  # each tree sees other rows, which varies the rules
        paths, step = _tree(x, np.where(drawn, y - p, 0.0), np.where(drawn, p * (1 - p), 0.0), cuts, DEPTH)
        logit = logit + 0.3 * step
        for path in paths:
            found.setdefault(tuple(sorted(path)), None)
    rules = list(found)
    design = np.stack([_holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    support = design.mean(axis=0)
    keep = np.flatnonzero((support > 0.002) & (support < 0.998))
    rules, design, support = [rules[k] for k in keep], design[:, keep], support[keep]
    scale = np.sqrt(support * (1 - support))
    centred = (design - support) / scale if len(rules) else design
    weights, intercept, ahead, momentum = np.zeros(len(rules)), base, np.zeros(len(rules)), 1.0
    rate = 4 * len(y) / max(np.linalg.norm(centred, 2) ** 2, 1e-9) if len(rules) else 1.0
    penalty = 2e-3
    for _ in range(500):
        p = 1 / (1 + np.exp(-(centred @ ahead + intercept)))
        intercept -= float((p - y).mean()) * 2
        moved = ahead - rate * (centred.T @ (p - y)) / len(y)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / faster * (new - weights)
        weights, momentum = new, faster
    raw = weights / scale if len(rules) else weights
    best = np.argsort(-np.abs(weights), kind="stable")[:RULES]
    best = best[weights[best] != 0]
    return Model([rules[k] for k in best], [float(raw[k]) for k in best], intercept - float((raw * support).sum()))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """Model of at most ``limit`` labelled ids, those with the smallest hash; without both labels a constant.

    Of the texts of a repeated id the least counts, so the sample has at most ``limit`` rows.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded, so it may be broadcast
    joined = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(some), "doc_id")
    joined = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    sample = store(statistics(joined, "doc_id", "quality"), "labelled")
    rows = sample.orderBy("doc_id", *STATISTICS).collect()
    if not rows:
        return Model([], [], 0.0)
    x = np.array([[r[s] for s in STATISTICS] for r in rows])
    y = np.array([float(r["quality"] > 0) for r in rows])
    if y.min() == y.max():
        return Model([], [], 4.0 if y[0] else -4.0)
    return fit_rules(x, y)


def quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` and the statistics of every row; null texts count as empty and are scored too.

    Repeated rows are scored alike, a score equal to ``threshold`` counts as above it, an empty table gives no rows.
    """
    scored = statistics(docs, "doc_id").withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
