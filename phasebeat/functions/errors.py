"""Column expressions for prediction errors and the anomaly step."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SMAPE_EPSILON = 1e-8
ZERO_STAND_IN = 0.001


def symmetric_term(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted) / (F.abs(actual) + F.abs(predicted) + F.lit(SMAPE_EPSILON))


def nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(ZERO_STAND_IN)).otherwise(c)


def mape(denominator: list[Column], other: list[Column]) -> Column:
    """Mean absolute percentage error over the resources of one tick."""
    terms = [F.abs((nonzero(d) - nonzero(o)) / nonzero(d)) for d, o in zip(denominator, other, strict=True)]
    return reduce(add, terms) / F.lit(float(len(terms))) * F.lit(100.0)


def confidence_step(idle: Column, seen: Column, cpu: Column, error: Column, cpu_floor: float, limit: float) -> Column:
    """+1 for suspicious, -1 for normal, 0 for idle."""
    suspicious = F.when(seen, error > F.lit(limit)).otherwise(cpu < F.lit(cpu_floor))
    return F.when(idle, F.lit(0)).when(suspicious, F.lit(1)).otherwise(F.lit(-1))
