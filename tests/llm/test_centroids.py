"""Shallot search against plain k-means in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasebeat.llm.centroids import Search, centroid_clusters, squared

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for _, _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = [(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found]
    return sorted(out, key=lambda r: (r[0] is None, r))


def vectors(rng, n, size):
    """Clustered, with repeated rows, ties, and rows that take no part."""
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [float(np.float32(m + rng.gauss(0, 0.2))) for m in rng.choice(middles)]
        rows.append((i, v))
    rows += [rows[3], rows[3], (None, rows[4][1]), (n, None), (n + 1, [0.5] * (size - 1)), (n + 2, [None] + [0.5] * (size - 1))]
    rows += [(n + 3, [math.nan] * size), (n + 4, [math.inf] * size), (n + 5, [])]
    return rows + [(n + 10 + i, [0.25] * size) for i in range(40)] + [(n + 100 + i, [0.0] * size) for i in range(20)]


@pytest.mark.parametrize("n, size, k, rounds", [(300, 8, 16, 3), (5, 3, 16, 2), (400, 2, 40, 5), (20, 4, 1, 2)])
def test_clusters(spark, n, size, k, rounds):
    rows = vectors(random.Random(n), n, size)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("x", "first", "second", "upper", "lower", "cluster", "distance")})
    found = [tuple(r) for r in centroid_clusters(df, k, rounds, size).collect()]
    assert sorted(found, key=lambda r: (r[0] is None, r)) == plain(rows, k, rounds, size)


def test_fewer_vectors_than_centroids_and_none(spark):
    found = centroid_clusters(spark.createDataFrame([(7, [1.0], 1)], SCHEMA), size=1).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in found] == [(7, 0, 0)]
    nothing = centroid_clusters(spark.createDataFrame([], SCHEMA))
    assert nothing.count() == 0
    assert nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="2\\^27"):
        centroid_clusters(spark.createDataFrame([(1, [3e9], 1), (2, [1.0], 1)], SCHEMA), size=1).collect()


def test_bounds_skip_most_scores_of_settled_vectors():
    """Moved a little, centroids leave most vectors where they are; the search then scores only the others."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (16, 8))
    x = centroids[rng.integers(0, 16, 5000)] + rng.integers(-60, 60, (5000, 8))
    state = [np.zeros(5000, np.int32), np.ones(5000, np.int32), np.full(5000, np.inf), np.zeros(5000)]
    Search(centroids, None)(x, *state)
    search, searched = Search(centroids + 3, centroids), []
    inner = search._search
    search._search = lambda x, open_, *rest: (searched.append(len(open_)), inner(x, open_, *rest))
    search(x, *state)
    exact = np.array([squared(x, c) for c in centroids + 3]).T
    assert (state[0] == exact.argmin(axis=1)).all()
    assert sum(searched) < 500
