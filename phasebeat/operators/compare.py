"""Comparison of algorithms over workloads, from the statistics files of their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.functions import text
from phasebeat.operators.ordered import scan


def _name(line: Column) -> Column:
    """The workload that a line of one word names, else null."""
    word = text.strip(line)
    return F.when((word != "") & ~word.rlike(r"\s"), word)


def named_workloads(lines: DataFrame, keys: tuple[str, ...] = ("algo",)) -> DataFrame:
    """Every workload that a file names, also one whose runs have no value."""
    rows = lines.select(*keys, _name(F.col("line")).alias("workload"))
    return rows.where(F.col("workload").isNotNull()).distinct()


def parse_stats(
    lines: DataFrame,
    stats: tuple[str, ...],
    failures: tuple[str, ...] = (),
    segment_rows: int | None = None,
    keys: tuple[str, ...] = ("algo",),
) -> DataFrame:
    """Values per repeat of a workload: ``(algo, workload, repeat, <stat> ...)``.

    ``lines`` has ``line_no, line`` and the ``keys`` that name a file.  A line of one word starts a block and names its workload.
    A block without values is no repeat.  Within a block the last value of a stat counts, and a line
    with one of the ``failures`` texts drops what came before it.
    """
    failed = F.lit(False)
    for f in failures:
        failed = failed | F.col("line").contains(f)
    rows = lines.withColumns({"name": _name(F.col("line")), "failed": failed})
    starts = F.when(F.col("name").isNotNull(), 1).otherwise(0)
    named = {"last_name": F.col("name")}
    rows = scan(rows, list(keys), "line_no", sums={"block": starts}, lasts=named, segment_rows=segment_rows)
    rows = rows.withColumn("workload", F.coalesce("name", "last_name"))

    # The first stat named in a line takes it, later ones do not look at it.
    taken, values = F.lit(False), {}
    for stat in stats:
        hit = F.col("line").contains(stat) & ~taken & F.col("name").isNull()
        values[stat] = F.when(hit, text.stat_value(F.col("line"), stat))
        taken = taken | F.col("line").contains(stat)
    rows = rows.withColumns(values)
    no = F.col("line_no")
    # The name is part of the key, so that the values alone are aggregated, by hashing.
    blocks = rows.groupBy(*keys, "block", "workload").agg(
        F.max(F.when(F.col("failed"), no)).alias("failed_at"),
        *[F.max_by(F.col(s), F.when(F.col(s).isNotNull(), no)).alias(s) for s in stats],
        *[F.max(F.when(F.col(s).isNotNull(), no)).alias(f"{s}_at") for s in stats],
    )
    valid = {s: F.when(F.col(f"{s}_at") > F.coalesce("failed_at", F.lit(-1)), F.col(s)) for s in stats}
    blocks = blocks.withColumns(valid)
    some = F.lit(False)
    for s in stats:
        some = some | F.col(s).isNotNull()
    return blocks.where(some & F.col("workload").isNotNull()).select(
        *keys, "workload", F.col("block").alias("repeat"), *stats
    )


def workload_means(repeats: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """Mean of each stat per algorithm and workload, with the number of repeats."""
    return repeats.groupBy("algo", "workload").agg(*[F.avg(s).alias(s) for s in stats], F.count("*").alias("repeats"))


def unequal_repeats(repeats: DataFrame, named: DataFrame) -> DataFrame:
    """Algorithms whose workloads do not all have the same number of repeats, none counted as zero."""
    found = repeats.groupBy("algo", "workload").agg(F.count("*").alias("n"))
    counts = named.join(found, ["algo", "workload"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    spread = counts.groupBy("algo").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return spread.where(F.col("least") != F.col("most"))


def compare(means: DataFrame, stat: str, algos: list[str]) -> DataFrame:
    """Workloads as rows, algorithms as columns; null where an algorithm lacks a workload."""
    return means.groupBy("workload").pivot("algo", algos).agg(F.first(stat))
