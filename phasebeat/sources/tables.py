"""Points, phase tables and report files: what the analysis writes and reads back."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasebeat.config import RESOURCES
from phasebeat.functions.text import places
from phasebeat.operators.reports import HOST_PREFIX, local_time, tagged
from phasebeat.schema import PROCESS

# Lines of statistics files and printed reports.
STATS_HEADING = "### Accuracy Rates ###"
ACCURACY_LABEL = " Prediction Accuracy: "
ANOMALY_LINE = "Anomaly Detected"
ACCURACY_PLACES = 3
REPORT_PLACES = 5

# Processes of all workers share so many history folders.
HISTORY_FOLDERS = 64

ALERTS = "alerts"
TAG_COLUMNS = ("time", "host", "experiment_name")


def prediction_points(predictions: DataFrame, *keep: str) -> DataFrame:
    """Fields of a prediction point: actual and predicted value of each resource."""
    return predictions.select(
        *TAG_COLUMNS,
        *[F.col(r).alias(f"actual_{r}") for r in RESOURCES],
        *[f"predicted_{r}" for r in RESOURCES],
        *keep,
    )


def accuracy_points(scored: DataFrame, *keep: str) -> DataFrame:
    """Accuracy points; a tick whose first accuracy is NaN has none."""
    fields = [f"acc_{r}" for r in RESOURCES]
    return scored.where(~F.isnan(fields[0])).select(*TAG_COLUMNS, *fields, *keep)


def alert_points(scored: DataFrame, *keep: str) -> DataFrame:
    """A point for each alert: the cluster, its phase and its confidence."""
    return scored.where("alert").select(*TAG_COLUMNS, "cluster", "phase_id", "confidence", *keep)


def write_points(points: DataFrame, root: str, measurement: str) -> None:
    """Append points to a folder per measurement, so that a report reads one measurement and its fields only."""
    points.write.mode("append").partitionBy("experiment_name").parquet(f"{root}/{measurement}")


def replace_points(points: DataFrame, root: str, measurement: str) -> None:
    """Write the points of one ``batch`` of a stream, in place of those an earlier try has left."""
    rows = points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("experiment_name", "batch").parquet(f"{root}/{measurement}")


def read_points(
    spark: SparkSession, root: str, measurement: str, host: str | None = None, experiment: str | None = None
) -> DataFrame:
    return tagged(spark.read.parquet(f"{root}/{measurement}"), host, experiment)


@contextmanager
def timed_step(spark: SparkSession, root: str, measurement: str, host: str, experiment: str) -> Iterator[None]:
    """Time a block of driver code, such as one job, and append its latency as a point."""
    start = time.time()
    yield
    latency = time.time() - start
    now = F.current_timestamp().alias("time")
    tags = [F.lit(host).alias("host"), F.lit(experiment).alias("experiment_name")]
    write_points(spark.range(1).select(now, *tags, F.lit(latency).alias("latency")), root, measurement)


def paired(actual: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Actual and predicted values of the same tick, where they are stored apart."""
    return actual.select(*keys, *RESOURCES).join(predicted.select(*keys, *[f"predicted_{r}" for r in RESOURCES]), keys)


def as_generic_points(points: DataFrame, measurement: str | None = None) -> DataFrame:
    """Any measurement as ``(measurement, time, host, experiment_name, fields)``."""
    known = {"measurement", *TAG_COLUMNS}
    fields = [c for c in points.columns if c not in known]
    pairs = [part for f in fields for part in (F.lit(f), F.col(f).cast("double"))]
    name = F.col("measurement") if measurement is None else F.lit(measurement)
    return points.select(name.alias("measurement"), *TAG_COLUMNS, F.create_map(*pairs).alias("fields"))


def write_generic_points(points: DataFrame, root: str) -> None:
    points.write.mode("append").partitionBy("measurement", "experiment_name").parquet(root)


def save_phases(root: str, version: int, **tables: DataFrame) -> None:
    """Save the phase tables of one moment under a new version folder."""
    for name, table in tables.items():
        table.write.parquet(f"{root}/version={version}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def load_phases(spark: SparkSession, root: str, version: int, name: str) -> DataFrame | None:
    """A saved phase table, ``None`` if nothing was saved."""
    path = f"{root}/version={version}/{name}"
    return spark.read.parquet(path) if exists(spark, path) else None


def accuracy_lines(
    run_accuracy: DataFrame, by: list[str], variant: str = "v2", anomaly: bool | Column = False, workload: str | None = None
) -> DataFrame:
    """The block that a run appends to its statistics file, as numbered lines, after the name of its workload if given.

    The first variant adds a line where ``anomaly`` holds.
    """
    lines = [F.lit(x) for x in (*([workload] if workload else []), "", STATS_HEADING)]
    lines += [
        F.concat(F.lit(r.upper() + ACCURACY_LABEL), places(F.col(f"acc_{r}"), ACCURACY_PLACES)) for r in RESOURCES
    ]
    if variant == "v1":
        lines.append(F.when(anomaly if isinstance(anomaly, Column) else F.lit(anomaly), F.lit(ANOMALY_LINE)))
    rows = run_accuracy.select(*by, F.posexplode(F.array(*lines)).alias("line_no", "line"))
    return rows.where(F.col("line").isNotNull())


def append_lines(lines: DataFrame, path: str, by: list[str]) -> None:
    """Append numbered lines as text, one file per group, whatever the number of groups."""
    ordered = lines.repartition(*by).sortWithinPartitions(*by, "line_no")
    ordered.select(*by, F.col("line").alias("value")).write.mode("append").partitionBy(*by).text(path)


def write_comparison(table: DataFrame, path: str, stat: str, algos: list[str]) -> str:
    """A comparison table as CSV, named after the stat and the algorithms."""
    target = f"{path}/{stat}{'_'.join(algos)}.csv"
    table.write.option("header", True).csv(target)
    return target


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV with the windows of each metric in time order, the mean after them."""
    tags = [c for c in report.columns if c not in ("section", "metric", "window_start", "value")]
    in_order = report.orderBy(*tags, "section", "metric", F.col("window_start").asc_nulls_last())
    in_order.write.option("header", True).csv(path)


def report_lines(report: DataFrame, zone: str = "UTC") -> DataFrame:
    """The printed line of each report row; window starts are wall-clock times of ``zone``."""
    name = F.regexp_replace("host", f"^{HOST_PREFIX}", "")
    value = places(F.col("value"), REPORT_PLACES)
    start = F.date_format(local_time(F.col("window_start").cast("timestamp_ntz"), zone), "yyyy-MM-dd HH:mm:ss")
    resource = F.regexp_replace("metric", "^predicted_", "")
    extreme = F.concat_ws(" ", F.initcap("section"), "metric", F.lit("for"), F.concat(name, F.lit(":")), value)
    number = F.col("value").cast("long").cast("string")
    counted = F.concat_ws(
        " ", F.lit("Number of"), resource, F.lit("predictions for"), F.concat(name, F.lit(":")), number
    )
    line = (
        F.when(F.col("section").isin("max", "min"), extreme)
        .when(F.col("section") == "frequency", counted)
        .when(F.col("window_start").isNotNull(), F.concat(start, F.lit(": "), value))
        .otherwise(F.concat(F.lit("mean: "), value))
    )
    return report.withColumn("line", line)


def append_history(samples: DataFrame, path: str, folders: int = HISTORY_FOLDERS) -> None:
    """Append ``cluster,worker,pid,count,cpu,mem`` lines; a process always has the same of a fixed number of folders."""
    line = F.concat_ws(",", *PROCESS, "count", "resource_data")
    folder = F.pmod(F.xxhash64(*PROCESS), F.lit(folders)).alias("folder")
    rows = samples.select(folder, line.alias("value")).repartition("folder")
    rows.write.mode("append").partitionBy("folder").text(path)
