"""Hard negatives against all scores in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasebeat.llm.hard_negatives import Rows, bounds, hard_negatives, scores

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, b) for b, (j, w, _) in enumerate(kept) if b != a)
        same = [s for s in scored if kept[s[3]][2] == label][:5]
        for ps, no_id, p, _ in same:
            fit = [s for s in scored if kept[s[3]][2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(i, None if no_id else p, r + 1, None if n else j, -ps, -ns) for r, (ns, n, j, _) in enumerate(fit)]
    return sorted(out, key=str)


def rows_of(rng, n, size=6):
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, 0.3))) for m in rng.choice(middles)], rng.randrange(4)) for i in range(n)]
    rows += [rows[10], rows[10], rows[20], (None, rows[30][1], 1), (None, rows[31][1], 2), (n, None, 1), (n + 1, [None] * size, 1)]
    rows += [(n + 2, [math.nan] * size, 1), (n + 3, [math.inf] * size, 1), (n + 4, rows[5][1], None), (n + 5, [], 1), (n + 6, [1.0], 2)]
    rows += [(n + 7, [0.5] * (size + 3), 3), (n + 8, [0.0] * size, 0)]
    return rows + [(n + 20 + i, rows[0][1], i % 3) for i in range(30)]


@pytest.mark.parametrize("tile_rows, block_rows", [(32_768, 512), (17, 3)])
def test_negatives(spark, tile_rows, block_rows):
    rows = rows_of(random.Random(3), 250)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("x", "tile", "slot", "anchor", "goal", "rank", "id", "uid", "score")})
    found = hard_negatives(df, every=10, tile_rows=tile_rows, block_rows=block_rows)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, 10)


def test_no_rows_and_no_anchors(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).columns == COLUMNS
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)).count() == 0


def test_too_long_a_vector_is_an_error(spark):
    with pytest.raises(Exception, match="too long"):
        hard_negatives(spark.createDataFrame([(100, [1e30], 1), (2, [1.0], 2)], SCHEMA)).collect()


@pytest.mark.parametrize("scale", [1, 300, 10**7])
def test_bounds_hold_every_score(scale):
    rng = np.random.default_rng(scale)
    references = rng.normal(size=(8, 12))
    references /= np.linalg.norm(references, axis=1, keepdims=True)
    x = rng.integers(-scale, scale + 1, (200, 12))
    x[::5] = x[0]
    x[1::5] = -x[0]
    x[2] = 0
    n = list(range(200))
    rows = Rows.unpacked(Rows.of(n, n, n, x.tolist(), references).record())
    low, high = bounds(rows, rows)
    i, j = np.divmod(np.arange(200 * 200), 200)
    exact = scores(rows, rows, i, j)
    assert (exact == (x @ x.T).ravel()).all()
    assert (low.ravel() <= exact).all() and (exact <= high.ravel()).all()
    assert (high - low).mean() < 2 * np.linalg.norm(x, axis=1).mean() ** 2
