"""Column expressions over stack sets: similarity, phase change, phase key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text after every function in a phase key.
ARROW = "->"
IDLE = ""


def similarity(a: Column, b: Column) -> Column:
    """Common share of two sets relative to the larger; null when both are empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger > 0, F.size(F.array_intersect(a, b)) / larger)


def changed(a: Column, b: Column, threshold: float) -> Column:
    return F.coalesce(similarity(a, b) < F.lit(threshold), F.lit(False))


def phase_key(prev: Column, curr: Column, change: Column) -> Column:
    """All current functions after a change, else the common ones; sorted; empty for idle."""
    names = F.array_sort(F.when(change, curr).otherwise(F.array_intersect(prev, curr)))
    return F.array_join(F.transform(names, lambda f: F.concat(f, F.lit(ARROW))), "")


def phase_id(key: Column) -> Column:
    """Short join key for a phase text that may be kilobytes long."""
    return F.md5(key)
