"""Stacks of aggregated thread dumps, from their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.functions import text
from phasebeat.operators.ordered import scan
from phasebeat.workspace import store


def stacks_of_lines(
    lines: DataFrame,
    keys: list[str],
    segment_rows: int | None = None,
    start: str = text.STACK_START,
    threads: str = text.THREADS_LINE,
) -> DataFrame:
    """``keys, stack, threads`` of dumps given as ``keys, line_no, line``; the lines are text without their ends.

    The same stacks as ``text.dump_stacks`` finds in a whole dump: a stack runs from the first line with ``start`` in a block of lines
    to the empty line that ends the block; one that no empty line ends is dropped.  Its thread count is the first token of the last
    ``threads`` line since the stack before it.

    A dump of any size is cut into blocks by a running count of empty lines that is carried over segments, and into groups of blocks
    by a running count of stacks, so no row and no task holds more than a segment of lines or one stack.  Blocks and stacks grow with the
    lines and compress well, so they are never broadcast.
    """
    empty, starts = F.col("line") == "", F.col("line").contains(start)
    rows = scan(lines, keys, "line_no", sums={"empties": empty.cast("long")}, segment_rows=segment_rows)
    rows = store(rows.withColumn("block", F.col("empties") - empty.cast("long")).drop("empties"), "dump-lines")
    counted = F.when(F.col("line").contains(threads), F.col("line_no"))
    blocks = rows.groupBy(*keys, "block").agg(
        F.min(F.when(starts, F.col("line_no"))).alias("first"),
        F.max(empty.cast("int")).alias("closed"),
        F.max_by("line", counted).alias("count_line"),
    )
    is_stack = F.col("first").isNotNull() & (F.col("closed") == 1)
    # A block without a stack lends its count to the next stack.
    numbered = scan(blocks, keys, "block", sums={"stacks": is_stack.cast("long")}, segment_rows=segment_rows)
    numbered = store(numbered.withColumn("group", F.col("stacks") - is_stack.cast("long")), "dump-blocks")
    known = F.when(F.col("count_line").isNotNull(), F.col("block"))
    counts = numbered.groupBy(*keys, "group").agg(F.max_by("count_line", known).alias("count_line"))
    found = numbered.where(is_stack).select(*keys, "block", "first", "group").join(counts.hint("merge"), [*keys, "group"])
    inside = rows.join(found.hint("merge"), [*keys, "block"]).where(F.col("line_no") >= F.col("first"))
    # One stack's lines meet here.
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    stacks = inside.groupBy(*keys, "block").agg(parts.alias("parts"), F.first("count_line").alias("count_line"))
    return stacks.select(
        *keys, F.array_join(F.transform("parts", lambda p: p["line"]), "").alias("stack"), text.first_token(F.col("count_line")).alias("threads")
    )
