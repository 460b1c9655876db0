"""K-means in integers with Shallot search.

Every vector remembers its centroid, its second-nearest one, an upper bound on the distance to the first and a lower bound on
the distance to all others.  When centroids move, the bounds are widened by what they moved.  Only a vector whose bounds
overlap is searched again: from the closer of its two remembered centroids outwards, over that centroid's neighbours in order of
distance, in a ball that shrinks with the second-best distance found.  Bounds are floating point and rounded outwards; what
survives them is compared in integers, so the result is that of the plain algorithm, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.workspace import drop, store

# Squared distances of vectors of up to 64 such components fit into 63 bits.
LIMIT = 1 << 27
STATE = "first int, second int, upper double, lower double"
# Floating point distances are widened by these factors before they decide anything.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def complete(vector: Column, size: int | None = None) -> Column:
    """Whether a vector is there and all its components are finite; with ``size`` also whether it has that many."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vector.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return whole if size is None else whole & (F.size(vector) == size)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to ``c``, or to the row of ``c`` beside it."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """The centroids of one round and what the search needs to know of them; of a size that depends on their number only."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(np.array([squared(centroids, c) for c in centroids], float).reshape(k, k))
        self.order = np.argsort(apart, axis=1, kind="stable")
        # A centroid may have an equal, so its own place is found by name.
        self.order = np.array([[j, *(i for i in row if i != j)] for j, row in enumerate(self.order)])
        self.apart = np.take_along_axis(apart, self.order, axis=1) * DOWN
        self.half = self.apart[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(float)) * UP
        self.others = np.array([np.delete(self.moved, j).max(initial=0.0) for j in range(k)])

    def __call__(self, x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring the state of the vectors ``x`` up to date, in place."""
        if len(self.centroids) < 2 or not len(x):
            upper[:] = np.sqrt(squared(x, self.centroids[0]).astype(float)) * UP if len(x) else upper
            return
        upper += self.moved[first]
        upper *= UP
        lower -= np.abs(lower) * (1 - DOWN) + self.others[first]
        safe = np.maximum(lower, self.half[first])
        open_ = np.flatnonzero(upper >= safe)
        upper[open_] = np.sqrt(squared(x[open_], self.centroids[first[open_]]).astype(float)) * UP
        open_ = open_[upper[open_] >= safe[open_]]
        if len(open_):
            self._search(x, open_, first, second, upper, lower)

    def _search(self, x, open_, first, second, upper, lower) -> None:
        rows, a, b = x[open_], first[open_], second[open_]
        da, db = squared(rows, self.centroids[a]), squared(rows, self.centroids[b])
        closer = (db < da) | ((db == da) & (b < a))
        start = np.where(closer, b, a)
        best, best_d = start.copy(), np.where(closer, db, da)
        next_, next_d = np.where(closer, a, b), np.where(closer, da, db)
        known = next_.copy()  # already scored
        reach = np.sqrt(best_d.astype(float)) * UP
        ball = np.sqrt(next_d.astype(float)) * UP
        live = np.arange(len(open_))
        for rank in range(1, len(self.centroids)):
            # A centroid farther from the start than both distances together is farther than the second best.
            live = live[self.apart[start[live], rank] <= reach[live] + ball[live]]
            if not len(live):
                break
            j = self.order[start[live], rank]
            fresh = j != known[live]
            at, j = live[fresh], j[fresh]
            d = squared(rows[at], self.centroids[j])
            win = (d < best_d[at]) | ((d == best_d[at]) & (j < best[at]))
            place = ~win & ((d < next_d[at]) | ((d == next_d[at]) & (j < next_[at])))
            w, p = at[win], at[place]
            next_[w], next_d[w] = best[w], best_d[w]
            best[w], best_d[w] = j[win], d[win]
            next_[p], next_d[p] = j[place], d[place]
            changed = at[win | place]
            ball[changed] = np.sqrt(next_d[changed].astype(float)) * UP
        first[open_], second[open_] = best, next_
        upper[open_] = np.sqrt(best_d.astype(float)) * UP
        lower[open_] = np.sqrt(next_d.astype(float)) * DOWN


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size).astype(np.int64)


def searched(rows: DataFrame, search: Search, size: int, fresh: bool) -> DataFrame:
    """The rows of ``rows`` with their state for the centroids of ``search``; ``fresh`` rows have none yet."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "x", "first", "second", "upper", "lower"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if fresh:
                state = [np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.zeros(n)]
            else:
                state = [np.array(batch[c]) for c in ("first", "second", "upper", "lower")]
            search(_matrix(batch, size), *state)
            columns = [batch["vec_id"], batch["x"], *[pa.array(s) for s in state]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(of, f"vec_id {kind}, x array<int>, {STATE}")


def measured(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with ``distance``, the squared distance to their first centroid."""
    size = centroids.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared(_matrix(batch, size), centroids[batch["first"].to_numpy()])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["first"], pa.array(d)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"vec_id {kind}, cluster int, distance long")


def _sums(rows: DataFrame, size: int) -> list:
    """Rows ``first, n, s`` of at most as many clusters as there are centroids."""
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(size)]
    by = rows.groupBy("first").agg(F.count("*").alias("n"), *sums)
    return by.select("first", "n", F.array(*[f"s{i}" for i in range(size)]).alias("s")).collect()


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, column: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector with ``size`` finite components.

    Components become ``floor(scale * x)``.  The first centroids are the ``k`` vectors with the smallest SHA-256 of ``1:<vec_id>``;
    vectors of one id follow each other by their components, null ids come last.  After each of ``rounds`` assignments every centroid
    that has vectors becomes the floor of their mean; equally near centroids give way to the smaller number.  With fewer than ``k``
    vectors each is a centroid.  Null vectors and those with a null, NaN or infinite component or another length are left out, repeated
    rows count one by one, an empty table gives no rows.  An integer of 2^27 or more is an error, since distances would not fit.

    A task holds one Arrow batch.  Only centroids and their sums pass through the driver.  Each round is a written table that
    replaces the one before.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{column}`")
    kept = vectors.where(complete(x, size)).select("vec_id", integers(x, scale).alias("x"))
    fits = F.forall("x", lambda v: v.between(1 - LIMIT, LIMIT - 1))
    checked = F.when(fits, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is 2^27 or more")).cast("array<int>"))
    rows = store(kept.select("vec_id", checked.alias("x")), "vectors")
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(name.asc_nulls_last(), "x").limit(k).collect()
    if not seeds:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, before = np.array([s["x"] for s in seeds], np.int64), None
    for turn in range(rounds + 1):
        old, rows = rows, store(searched(rows, Search(centroids, before), size, fresh=turn == 0), "assigned")
        drop(old)
        if turn < rounds:
            before, centroids = centroids, centroids.copy()
            for r in _sums(rows, size):
                centroids[r["first"]] = [s // r["n"] for s in r["s"]]
    assigned = store(measured(rows, centroids), "distances")
    drop(rows)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = {r["cluster"]: int(r["t"]) for r in assigned.groupBy("cluster").agg(total.alias("t")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(j, t, sum(by.values()), digests[j]) for j, t in by.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
