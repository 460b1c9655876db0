"""Reports over stored metric points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.config import Settings

TAGS = ["host", "experiment_name"]

# Measurements and metrics of the full report, in report order.
RESOURCE_POINTS = "monitor_resource_consumption"
RESOURCE_METRICS = ("cpu", "mem", "download", "upload")
PREDICTION_POINTS = "predictions"
PREDICTION_METRICS = ("actual_cpu", "predicted_cpu", "actual_mem", "predicted_mem")
COUNTED_METRICS = ("predicted_cpu", "predicted_mem")
LATENCY_POINTS = (
    "data_collection_latency",
    "prediction_latency",
    "ml_model_update_latency",
    "anomaly_detection_latency",
)
ACCURACY_POINTS = "accuracy"
ACCURACY_METRICS = ("acc_cpu", "acc_mem")
HOST_PREFIX = "runner-"


def host_of(experiment_id: str) -> str:
    return HOST_PREFIX + experiment_id


def tagged(points: DataFrame, host: str | None = None, experiment: str | None = None) -> DataFrame:
    """Points of one host and experiment; both tests reach the scan."""
    if host is not None:
        points = points.where(F.col("host") == host)
    if experiment is not None:
        points = points.where(F.col("experiment_name") == experiment)
    return points


def window_means(
    points: DataFrame, metrics: tuple[str, ...], by: list[str], window: str = Settings.window
) -> DataFrame:
    """Mean per tumbling window, one row per metric; windows whose mean is null or zero are left out.

    All metrics are averaged in one aggregation and only its small result is spread into rows.
    """
    means = points.groupBy(*by, F.window("time", window).alias("w")).agg(*[F.avg(m).alias(m) for m in metrics])
    rows = _spread(means.withColumn("window_start", F.col("w.start")), [*by, "window_start"], metrics, "mean")
    return rows.where(F.col("mean").isNotNull() & (F.col("mean") != 0))


def mean_of_means(windows: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean of the kept windows; a metric without any has no row."""
    return windows.groupBy(*by, "metric").agg(F.avg("mean").alias("mean"), F.count("*").alias("windows"))


def extremes(points: DataFrame, metrics: tuple[str, ...], by: list[str]) -> DataFrame:
    """Maximum, minimum and number of non-null values per metric, in one pass."""
    stats = points.groupBy(*by).agg(
        *[F.struct(F.max(m).alias("max"), F.min(m).alias("min"), F.count(m).alias("count")).alias(m) for m in metrics]
    )
    rows = _spread(stats, by, metrics, "s")
    return rows.select(*by, "metric", "s.max", "s.min", "s.count")


def _spread(wide: DataFrame, keys: list[str], metrics: tuple[str, ...], value: str) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).alias(value)) for m in metrics]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.metric", f"e.{value}")


def summary(points: DataFrame, metrics: tuple[str, ...], by: list[str], window: str = Settings.window) -> DataFrame:
    """Everything a report says about a measurement, from one scan: ``(kind, metric, window_start, value)``.

    Kinds are ``window`` (mean of one window), ``mean`` (mean of the kept windows), ``max``, ``min`` and
    ``count``; only ``window`` rows have a window.
    """
    stats = points.groupBy(*by, F.window("time", window).alias("w")).agg(
        *[f(m).alias(f"{m}_{k}") for m in metrics for k, f in _PARTIAL.items()]
    )
    # Both levels come from one pass over the windows, still one row per window for all metrics.
    wide = stats.withColumn("window_start", F.col("w.start")).drop("w")
    both = wide.groupingSets([[*by, "window_start"], by], *by, "window_start").agg(
        *[F.avg(F.when(F.col(f"{m}_mean") != 0, F.col(f"{m}_mean"))).alias(f"{m}_mean") for m in metrics],
        *[f(F.col(f"{m}_{k}")).cast("double").alias(f"{m}_{k}") for m in metrics for k, f in _TOTAL.items()],
        F.grouping("window_start").alias("total"),
    )

    def entry(kind: str, metric: str, value: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.col(value).alias("value"))

    one_window = F.array(*[entry("window", m, f"{m}_mean") for m in metrics])
    whole = F.array(*[entry(k, m, f"{m}_{k}") for m in metrics for k in ("mean", *_TOTAL)])
    rows = both.select(*by, "window_start", F.explode(F.when(F.col("total") == 1, whole).otherwise(one_window)).alias("e"))
    return rows.select(*by, "e.kind", "e.metric", "window_start", "e.value").where(F.col("value").isNotNull())


_PARTIAL = {"mean": F.avg, "max": F.max, "min": F.min, "count": F.count}
_TOTAL = {"max": F.max, "min": F.min, "count": F.sum}


def report(points: DataFrame, metric: str, op: str, by: list[str] = TAGS, window: str = Settings.window) -> DataFrame:
    """One report call: ``max``, ``min``, ``freq``, or ``avg`` / ``latency`` (windows and their mean)."""
    if op in ("max", "min", "freq"):
        column = "count" if op == "freq" else op
        return extremes(points, (metric,), by).select(*by, "metric", F.col(column).cast("double").alias("value"))
    if op in ("avg", "latency"):
        field = "latency" if op == "latency" else metric
        rows = summary(points, (field,), by, window).where(F.col("kind").isin("window", "mean"))
        return rows.select(*by, F.lit(metric).alias("metric"), "window_start", "value")
    raise ValueError(f"unknown operation {op!r}")


def full_report(points: dict[str, DataFrame], by: list[str] = TAGS, window: str = Settings.window) -> DataFrame:
    """All sections as ``(section, metric, window_start, value)`` per tag set.

    ``points`` maps a measurement to its points, one column per field; one that is not there is left out.  Each
    measurement is scanned once.  Mean-of-means rows have a null window.
    """
    kind, averages = F.col("kind"), F.col("kind").isin("window", "mean")
    counted = (kind == "count") & F.col("metric").isin(*COUNTED_METRICS)
    sections = {
        RESOURCE_POINTS: (RESOURCE_METRICS, F.when(averages, F.lit("average_resources")).when(kind != "count", kind)),
        PREDICTION_POINTS: (PREDICTION_METRICS, F.when(averages, F.lit("average_predictions")).when(counted, F.lit("frequency"))),
        ACCURACY_POINTS: (ACCURACY_METRICS, F.when(averages, F.lit("accuracy"))),
    }
    parts = [
        summary(points[name], metrics, by, window).withColumn("section", section)
        for name, (metrics, section) in sections.items()
        if name in points
    ]
    timed = [points[n].select(*by, "time", "latency", F.lit(n).alias("step")) for n in LATENCY_POINTS if n in points]
    if timed:
        latency = summary(reduce(DataFrame.unionByName, timed), ("latency",), [*by, "step"], window)
        latency = latency.withColumn("metric", F.col("step")).drop("step")
        parts.append(latency.withColumn("section", F.when(averages, F.lit("latency"))))
    if not parts:
        raise ValueError("no measurement of the report has points")
    rows = reduce(DataFrame.unionByName, parts).where(F.col("section").isNotNull())
    return rows.select(*by, "section", "metric", "window_start", "value")


def local_time(utc: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of a UTC time given without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def utc_text_to_time(c: Column) -> Column:
    return F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def step_latencies(steps: DataFrame) -> DataFrame:
    """Latency in seconds of each ``(step, start, end)``, as points of a measurement named after the step."""
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("end", "start")]
    return steps.withColumn("latency", (micros[0] - micros[1]) / F.lit(1e6)).withColumnsRenamed(
        {"step": "measurement", "start": "time"}
    ).drop("end")
