"""Workload runs seen by the sampling agent of one worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.operators.ordered import scan

WORKER = ["cluster", "worker"]


def workload_changes(samples: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Samples whose pid differs from the last observed one; idle samples do not reset it."""
    pid = F.col("pid")
    rows = scan(samples, WORKER, "tick", lasts={"last_pid": pid}, segment_rows=segment_rows)
    return rows.where(pid.isNotNull() & ~pid.eqNullSafe(F.col("last_pid"))).drop("last_pid")


def sample_numbers(samples: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Number the samples from 0, starting anew after idle; null for idle samples.

    A new pid without an idle sample in between does not start anew.
    """
    busy = F.col("pid").isNotNull()
    rows = scan(samples, WORKER, "tick", sums={"busy": busy.cast("long")}, segment_rows=segment_rows)
    base = {"base": F.when(~busy, F.col("busy"))}
    rows = scan(rows, WORKER, "tick", lasts=base, segment_rows=segment_rows)
    number = F.col("busy") - F.coalesce("base", F.lit(0)) - 1
    return rows.withColumn("sample_no", F.when(busy, number)).drop("busy", "base")
