"""Exact lasso with two features and an intercept.

Minimises ``sum((y - x.w - b)^2) / (2 n) + alpha * sum(|w|)``.  With two features the optimum is one
of seven candidates: zero, one feature alone, or both with one of four sign patterns.  The
candidate with the least objective is taken; on ties the earlier one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Below this share of S11 * S22 the determinant counts as zero.
SINGULAR = 1e-12
SIGNS = ((1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0))


def _sum(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def with_lasso(df: DataFrame, points: dict[str, list[tuple[str, str, str]]], alpha: float) -> DataFrame:
    """Add ``<r>_w_prev2, <r>_w_prev1, <r>_intercept`` for each resource ``r`` of ``points``.

    ``points[r]`` names the (prev2, prev1, target) columns of each training point of a row.
    Steps are separate projections, so that no expression is evaluated twice.
    """
    steps: list[dict[str, str]] = [{}, {}, {}, {}, {}, {}, {}, {}]
    means, moments, single, pairs, costs, fits, weights, result = steps
    for r, rows in points.items():
        n = f"{float(len(rows))}D"
        for k, name in enumerate(("m1", "m2", "my")):
            means[f"{r}_{name}"] = f"{_sum([p[k] for p in rows])} / {n}"
        centred = [[f"({p[k]} - {r}_{m})" for p in rows] for k, m in enumerate(("m1", "m2", "my"))]
        d1, d2, dy = centred
        for name, u, v in (("s11", d1, d1), ("s12", d1, d2), ("s22", d2, d2), ("c1", d1, dy), ("c2", d2, dy)):
            moments[f"{r}_{name}"] = f"{_sum([f'{p} * {q}' for p, q in zip(u, v)])} / {n}"
        s11, s12, s22, c1, c2, det = (f"{r}_{x}" for x in ("s11", "s12", "s22", "c1", "c2", "det"))
        single[det] = f"{s11} * {s22} - {s12} * {s12}"
        for name, c, s in (("only1", c1, s11), ("only2", c2, s22)):
            soft = f"greatest(abs({c}) - {alpha}D, 0D) * signum({c})"
            single[f"{r}_{name}"] = f"CASE WHEN {s} > 0 THEN {soft} / {s} ELSE 0D END"
        candidates = [("0D", "0D", "true"), (f"{r}_only1", "0D", "true"), ("0D", f"{r}_only2", "true")]
        for i, (g1, g2) in enumerate(SIGNS):
            e1, e2 = f"({c1} - {alpha * g1}D)", f"({c2} - {alpha * g2}D)"
            p, q = f"{r}_p{i}", f"{r}_q{i}"
            solvable = f"{det} > {SINGULAR}D * {s11} * {s22}"
            pairs[p] = f"CASE WHEN {solvable} THEN ({s22} * {e1} - {s12} * {e2}) / {det} END"
            pairs[q] = f"CASE WHEN {solvable} THEN ({s11} * {e2} - {s12} * {e1}) / {det} END"
            candidates.append((p, q, f"{p} * {g1}D > 0 AND {q} * {g2}D > 0"))
        for rank, (u, v, valid) in enumerate(candidates):
            gain = f"({c1} * {u} + {c2} * {v} - {alpha}D * (abs({u}) + abs({v})))"
            cost = f"0.5D * ({s11} * {u} * {u} + 2D * {s12} * {u} * {v} + {s22} * {v} * {v}) - {gain}"
            costs[f"{r}_cost{rank}"] = f"CASE WHEN {valid} THEN {cost} END"
        ranks = range(len(candidates))
        fits[f"{r}_least"] = f"least({', '.join(f'{r}_cost{rank}' for rank in ranks)})"
        for k, part in enumerate(("prev2", "prev1")):
            chosen = " ".join(f"WHEN {r}_cost{rank} = {r}_least THEN {candidates[rank][k]}" for rank in ranks)
            weights[f"{r}_w_{part}"] = f"CASE {chosen} END"
        result[f"{r}_intercept"] = f"{r}_my - {r}_w_prev2 * {r}_m1 - {r}_w_prev1 * {r}_m2"
    for step in steps:
        df = df.withColumns({name: F.expr(e) for name, e in step.items()})
    return df.drop(*[name for step in steps[:-2] for name in step])


def fit_points(points: Sequence[tuple[float, float, float]], alpha: float) -> tuple[float, float, float]:
    """The same fit for one small list of points, for the stateful steps."""
    n = float(len(points))

    def mean(values: Sequence[float]) -> float:
        # Plain adding in order, as the column form does; the built-in sum corrects its rounding.
        total = values[0]
        for v in values[1:]:
            total += v
        return total / n

    x1, x2, target = zip(*points)
    m1, m2, my = mean(x1), mean(x2), mean(target)
    d1, d2, dy = [v - m1 for v in x1], [v - m2 for v in x2], [v - my for v in target]
    s11, s12, s22 = mean([u * u for u in d1]), mean([u * v for u, v in zip(d1, d2)]), mean([v * v for v in d2])
    c1, c2 = mean([u * y for u, y in zip(d1, dy)]), mean([v * y for v, y in zip(d2, dy)])

    def soft(c: float, s: float) -> float:
        size = max(abs(c) - alpha, 0.0)
        return (size if c > 0 else -size) / s if s > 0 else 0.0

    candidates = [(0.0, 0.0), (soft(c1, s11), 0.0), (0.0, soft(c2, s22))]
    det = s11 * s22 - s12 * s12
    if det > SINGULAR * s11 * s22:
        for g1, g2 in SIGNS:
            e1, e2 = c1 - alpha * g1, c2 - alpha * g2
            w1, w2 = (s22 * e1 - s12 * e2) / det, (s11 * e2 - s12 * e1) / det
            if w1 * g1 > 0 and w2 * g2 > 0:
                candidates.append((w1, w2))

    def cost(w: tuple[float, float]) -> float:
        gain = c1 * w[0] + c2 * w[1] - alpha * (abs(w[0]) + abs(w[1]))
        return 0.5 * (s11 * w[0] * w[0] + 2.0 * s12 * w[0] * w[1] + s22 * w[1] * w[1]) - gain

    w1, w2 = min(candidates, key=cost)
    return w1, w2, my - w1 * m1 - w2 * m2


def fit_many(points: np.ndarray, alpha: float) -> np.ndarray:
    """The same fit for many lists of points at once: ``points[i]`` has rows (prev2, prev1, target), the result a row per list."""
    n = float(points.shape[1])

    def mean(values: np.ndarray) -> np.ndarray:
        # Plain adding in order, as the other forms do; the built-in sum may add in pairs.
        return reduce(add, values.T) / n

    m1, m2, my = (mean(points[:, :, k]) for k in range(3))
    d1, d2, dy = (points[:, :, k] - m[:, None] for k, m in enumerate((m1, m2, my)))
    s11, s12, s22, c1, c2 = (mean(u * v) for u, v in ((d1, d1), (d1, d2), (d2, d2), (d1, dy), (d2, dy)))

    def soft(c: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.divide(np.maximum(np.abs(c) - alpha, 0.0) * np.sign(c), s, out=np.zeros_like(s), where=s > 0)

    zero = np.zeros_like(s11)
    candidates = [(zero, zero), (soft(c1, s11), zero), (zero, soft(c2, s22))]
    valid = [np.ones_like(s11, bool)] * 3
    det = s11 * s22 - s12 * s12
    solvable = det > SINGULAR * s11 * s22
    for g1, g2 in SIGNS:
        e1, e2 = c1 - alpha * g1, c2 - alpha * g2
        w1 = np.divide(s22 * e1 - s12 * e2, det, out=np.zeros_like(det), where=solvable)
        w2 = np.divide(s11 * e2 - s12 * e1, det, out=np.zeros_like(det), where=solvable)
        candidates.append((w1, w2))
        valid.append(solvable & (w1 * g1 > 0) & (w2 * g2 > 0))
    costs = []
    for (w1, w2), ok in zip(candidates, valid, strict=True):
        gain = c1 * w1 + c2 * w2 - alpha * (np.abs(w1) + np.abs(w2))
        cost = 0.5 * (s11 * w1 * w1 + 2.0 * s12 * w1 * w2 + s22 * w2 * w2) - gain
        costs.append(np.where(ok, cost, np.inf))
    # The first of the least, as the other forms take it.
    best = np.argmin(np.stack(costs), axis=0)
    at = np.arange(len(best))
    w1, w2 = (np.stack([c[k] for c in candidates])[best, at] for k in range(2))
    return np.stack([w1, w2, my - w1 * m1 - w2 * m2], axis=1)
