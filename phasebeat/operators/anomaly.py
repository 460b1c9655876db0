"""Accuracy of predictions, and anomalies from a running confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.config import RESOURCES, Settings
from phasebeat.functions import errors
from phasebeat.operators.ordered import scan


def smape_accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """``100 - 100 * mean`` of the symmetric error per resource and group."""
    return predictions.groupBy(*by).agg(
        *[
            (F.lit(100.0) - F.avg(errors.symmetric_term(F.col(r), F.col(f"predicted_{r}"))) * 100.0).alias(f"acc_{r}")
            for r in RESOURCES
        ]
    )


def anomaly_steps(predictions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add the error of the tick (prediction as denominator) and the step of the confidence."""
    error = errors.mape([F.col(f"predicted_{r}") for r in RESOURCES], [F.col(r) for r in RESOURCES])
    rows = predictions.withColumn("mape", error)
    step = errors.confidence_step(
        F.col("idle"), F.col("seen"), F.col(RESOURCES[0]), F.col("mape"), settings.cpu_floor, settings.mape_limit
    )
    return rows.withColumn("step", step.cast("long"))


def scored(
    predictions: DataFrame,
    settings: Settings = Settings(),
    segment_rows: int | None = None,
    stop_at_first: bool = False,
    start_confidence: int = 0,
) -> DataFrame:
    """Add confidence, alert flag and running accuracy per cluster.

    Confidence has no floor and is not reset.  ``stop_at_first`` keeps the ticks up to and including
    the first alert of each cluster, as if the run had ended there.  The running accuracy includes the
    current tick, in the first variant it does not and the first value is NaN.
    """
    rows = anomaly_steps(predictions, settings)
    terms = {f"sum_{r}": errors.symmetric_term(F.col(r), F.col(f"predicted_{r}")) for r in RESOURCES}
    rows = rows.withColumns(terms)
    sums = {"confidence": F.col("step"), "ticks": F.lit(1)} | {f"run_{n}": F.col(n) for n in terms}
    rows = scan(rows, ["cluster"], "tick_no", sums=sums, segment_rows=segment_rows)
    rows = rows.withColumn("confidence", F.col("confidence") + F.lit(start_confidence))
    v1 = settings.variant == "v1"
    count = F.col("ticks") - 1 if v1 else F.col("ticks")
    accuracy = {}
    for r in RESOURCES:
        total = F.col(f"run_sum_{r}") - F.col(f"sum_{r}") if v1 else F.col(f"run_sum_{r}")
        accuracy[f"acc_{r}"] = F.when(count > 0, F.lit(100.0) - total / count * 100.0).otherwise(F.lit(float("nan")))
    rows = rows.withColumns(accuracy | {"alert": F.col("confidence") > settings.confidence_limit})
    rows = rows.drop("ticks", *terms, *[f"run_{n}" for n in terms])
    return until_first_alert(rows, segment_rows) if stop_at_first else rows


def until_first_alert(scored_ticks: DataFrame, segment_rows: int | None = None) -> DataFrame:
    fired = F.col("alert").cast("long")
    rows = scan(scored_ticks, ["cluster"], "tick_no", sums={"alerts": fired}, segment_rows=segment_rows)
    return rows.where(F.col("alerts") - fired == 0).drop("alerts")


def alerts(scored_ticks: DataFrame) -> DataFrame:
    return scored_ticks.where("alert")
