"""Segmented scans against a plain loop over each sequence."""

import random

import pytest
from pyspark.sql import functions as F

from phasebeat.operators.dumps import stacks_of_lines
from phasebeat.operators.ordered import scan


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        total, last, seen = 0, None, []
        for _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total += v or 0
            out[key, i] = (total, last, seen[-1] if seen else None, seen[-2] if len(seen) > 1 else None)
            last = v if v is not None else last
            seen.append(v)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("cut", [None, 2, 5, 64])
def test_scan(spark, seed, cut):
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 150), ("a", 20), ("b", 1), ("c", 5)):
        for i in rng.sample(range(-50, 400), n):
            rows.append((key, i, rng.choice([None, None, rng.randint(-9, 9)])))
    df = spark.createDataFrame(rows, "key string, i long, v long").repartition(5)
    v = F.col("v")
    got = scan(df, ["key"], "i", sums={"s": v}, lasts={"l": v}, lags={"p1": ("v", 1), "p2": ("v", 2)}, segment_rows=cut)
    assert got.columns == ["key", "i", "v", "s", "l", "p1", "p2"]
    assert {(r.key, r.i): (r.s, r.l, r.p1, r.p2) for r in got.collect()} == brute(rows)


def test_only_lags(spark):
    rows = [("a", i, i) for i in (1, 2, 3, 10, 20, 21)]
    df = spark.createDataFrame(rows, "key string, i long, v long")
    for cut in (None, 2, 4):
        got = scan(df, ["key"], "i", lags={"p2": ("v", 2)}, segment_rows=cut).orderBy("i").collect()
        assert [r.p2 for r in got] == [None, None, 1, 2, 3, 10]


def test_no_task_sorts_a_whole_hot_key(spark):
    """Windows of a segmented scan run per segment; only one-row summaries are ordered by key alone."""
    df = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").alias("i"), F.col("id").alias("v"))
    plan = scan(df, ["key"], "i", sums={"s": F.col("v")}, segment_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    whole = [w for w in windows if "__segment" not in w.split("], [")[1]]
    assert len(windows) == 2 and len(whole) == 1
    assert "__s_s" in whole[0]


def test_carry_is_not_broadcast(spark):
    """Small files may hold many rows, so the carry and the blocks of dumps are merged whatever their bytes."""
    rows = spark.range(100).select(F.lit("hot").alias("key"), F.col("id").alias("line_no"), F.lit("at x").alias("line"))
    scanned = scan(rows, ["key"], "line_no", sums={"s": F.col("line_no")}, segment_rows=10)
    for found in (scanned, stacks_of_lines(rows, ["key"], 10)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
