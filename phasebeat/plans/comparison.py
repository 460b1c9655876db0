"""Comparison of algorithms from their statistics files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasebeat.config import SEGMENT_ROWS
from phasebeat.operators import compare
from phasebeat.sources.samples import read_lines
from phasebeat.workspace import store


def compare_files(
    spark: SparkSession, files: dict[str, str], stats: tuple[str, ...], failures: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """A table workload x algorithm per stat.

    ``files`` maps an algorithm to its statistics file.  Workloads of one file must have equally many repeats.
    """
    logs = [read_lines(spark, path).withColumn("algo", F.lit(algo)) for algo, path in files.items()]
    lines = store(reduce(DataFrame.unionByName, logs).select("algo", "line_no", "line"), "stats_lines")
    repeats = store(compare.parse_stats(lines, stats, failures, SEGMENT_ROWS), "repeats")
    # At most one row per file that was given.
    uneven = sorted(r["algo"] for r in compare.unequal_repeats(repeats, compare.named_workloads(lines)).collect())
    if uneven:
        raise ValueError(f"workloads differ in their number of repeats: {', '.join(uneven)}")
    means = compare.workload_means(repeats, stats)
    return {stat: compare.compare(means, stat, list(files)) for stat in stats}
