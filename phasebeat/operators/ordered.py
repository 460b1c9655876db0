"""Running totals, last known values and shifted rows over long ordered sequences.

Every sequence is indexed by a unique integer (tick, visit, line number) and cut into segments of
``segment_rows`` consecutive indexes: windows run per (key, segment), one summary row per segment is
carried over the segments, and the carry is joined back.  The plan is the same at every size, and a
single key may hold any share of the table.  Keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phasebeat.config import SEGMENT_ROWS
from phasebeat.workspace import stored

SEGMENT = "__segment"


def whole_part(column: str, by: int) -> Column:
    """Whole-number quotient rounded down, exact for every 64-bit integer."""
    return F.expr(f"({column} - pmod({column}, {by})) div {by}")


def scan(
    df: DataFrame,
    keys: list[str],
    index: str,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    lags: dict[str, tuple[str, int]] | None = None,
    segment_rows: int | None = SEGMENT_ROWS,
) -> DataFrame:
    """Add ordered columns to ``df``.

    ``sums``: running total up to and including the row (nulls count as zero).
    ``lasts``: last non-null value strictly before the row, null if there is none.
    ``lags``: ``(column, 1 or 2)``, the value that many rows back, null if there is none.
    ``segment_rows=None`` scans each sequence in one task, for keys that are known to be short.
    """
    sums, lasts, lags = sums or {}, lasts or {}, lags or {}
    if segment_rows is None:
        return _local(df, keys, index, sums, lasts, lags)
    rows = stored(df, "sequence").withColumn(SEGMENT, whole_part(index, segment_rows))
    within = [*keys, SEGMENT]
    local = _local(rows, within, index, sums, lasts, lags)
    order = W.partitionBy(*within).orderBy(index)
    if lags:
        local = local.withColumn("__pos", F.row_number().over(order))
    shifted = sorted({column for column, _ in lags.values()})
    # Without it the ends of the segments need no sorted rows.
    two_back = any(back == 2 for _, back in lags.values())

    totals = [F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
    known = [F.max_by(c, F.when(c.isNotNull(), F.col(index))).alias(f"__l_{n}") for n, c in lasts.items()]
    if lags:
        tail = F.struct(*[F.col(c).alias(c) for c in shifted])
        ends = rows.select(*within, index, *_inputs(rows, within, index, sums, lasts), tail.alias("__row"))
        kept = ["__row"]
        if two_back:
            ends = ends.withColumn("__before", F.lag("__row").over(order))
            kept.append("__before")
        known += [
            F.max_by(F.struct(*kept), F.col(index)).alias("__tail"),
            F.count("*").alias("__rows"),
        ]
    else:
        ends = rows
    summary = ends.groupBy(*within).agg(*totals, *known)

    by_segment = W.partitionBy(*keys).orderBy(SEGMENT)
    earlier = by_segment.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.sum(f"__s_{n}").over(earlier).alias(f"__c_{n}") for n in sums]
    carried += [F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in lasts]
    if lags:
        carried.append(F.lag("__tail.__row").over(by_segment).alias("__back1"))
    if two_back:
        # A one-row segment has no second-last row of its own: it is the last one further back.
        second = F.when(F.lag("__rows").over(by_segment) > 1, F.lag("__tail.__before").over(by_segment))
        carried.append(F.coalesce(second, F.lag("__tail.__row", 2).over(by_segment)).alias("__back2"))
    carry = summary.select(*within, *carried)

    # Both sides grow with the sequence.  Stored tables and shuffles are compressed, so their bytes say little about the
    # memory that a broadcast would take; the rows are sorted by segment already.
    joined = local.join(carry.hint("merge"), within)
    joined = joined.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
        | {n: F.coalesce(F.col(n), F.col(f"__c_{n}")) for n in lasts}
        | {n: _carried_lag(n, column, back) for n, (column, back) in lags.items()}
    )
    return joined.select(*df.columns, *sums, *lasts, *lags)


def _inputs(rows, within, index, sums, lasts) -> list[str]:
    """Columns that the summary may need besides the shifted ones."""
    if not sums and not lasts:
        return []
    return [c for c in rows.columns if c not in within and c != index]


def _carried_lag(name: str, column: str, back: int) -> Column:
    pos, local = F.col("__pos"), F.col(name)
    first = F.col(f"__back1.{column}")
    if back == 1:
        return F.when(pos > 1, local).otherwise(first)
    if back == 2:
        return F.when(pos > 2, local).when(pos == 2, first).otherwise(F.col(f"__back2.{column}"))
    raise ValueError("only one or two rows back")


def _local(df, keys, index, sums, lasts, lags) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(index)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns(
        {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
        | {n: F.last(c, ignorenulls=True).over(before) for n, c in lasts.items()}
        | {n: F.lag(c, back).over(order) for n, (c, back) in lags.items()}
    )
