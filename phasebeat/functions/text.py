"""Column expressions over raw sample and dump text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks in thread dumps, samples and logs.
ADDRESS = "<0x[0-9a-zA-Z]*>"
COUNT_MARK = "***"
STACK_START = "Stack:"
THREADS_LINE = "threads with trace"
SPARK_WORD = "spark"
EXECUTOR_CLASS = "CoarseGrainedExecutorBackend"
HEADER_WORD = "CPU"
IDLE_LINE = "0,0"
BLANKS = " \t\n\r\x0b\x0c"

# Text that counts as a number: digits may be grouped by single underscores, blanks around
# are allowed, hexadecimal and type suffixes are not.
_DIGITS = "[0-9](?:_?[0-9])*"
NUMBER = rf"^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$"
NON_FINITE = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def scrub_addresses(c: Column) -> Column:
    return F.regexp_replace(c, ADDRESS, "")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def drop_thread_count(c: Column) -> Column:
    """Text before the first count mark; a blank before the mark stays."""
    return F.substring_index(c, COUNT_MARK, 1)


def function_name(c: Column) -> Column:
    """``drop_thread_count`` of the stripped text; behind a mark nothing needs stripping, which is the slow end."""
    cut = F.ltrim(drop_thread_count(c), F.lit(BLANKS))
    return F.when(F.contains(c, F.lit(COUNT_MARK)), cut).otherwise(strip(c))


def sorted_texts(texts: Column) -> Column:
    """The texts of an array in order, without nulls; no comparison is a function call as in ``array_sort``."""
    return F.sort_array(F.array_compact(texts))


def first_token(c: Column) -> Column:
    return F.split(strip(c), r"\s+")[0]


def to_number(c: Column, accept_non_finite: bool = False) -> Column:
    """Float value of a text, null where it has none."""
    plain = F.when(c.rlike(NUMBER), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))
    if not accept_non_finite:
        return plain
    return plain.when(c.rlike(NON_FINITE), c.try_cast("double"))


def resource_field(line: Column, position: int, fields: int = 2, accept_non_finite: bool = False) -> Column:
    """One resource of a ``cpu,mem`` line; null if the line or that field is malformed."""
    return field_number(F.split(line, ",", -1), position, fields, accept_non_finite)


def field_number(parts: Column, position: int, fields: int, accept_non_finite: bool = False) -> Column:
    return F.when(F.size(parts) == fields, to_number(F.get(parts, F.lit(position)), accept_non_finite))


def live_resource_line(pid: Column, line: Column) -> Column:
    """A missing process, or one that died so that only the header row is left, uses nothing."""
    return F.when(pid.isNull() | line.contains(HEADER_WORD), F.lit(IDLE_LINE)).otherwise(line)


def is_executor(name: Column) -> Column:
    return name.contains(EXECUTOR_CLASS)


def mentions_spark(c: Column) -> Column:
    return c.contains(SPARK_WORD)


def dump_stacks(text: Column, start: str = STACK_START, threads: str = THREADS_LINE) -> Column:
    """Stacks of an aggregated dump as ``array<struct<stack, threads>>``, in the row, without a shuffle.

    A stack runs from a line with ``start`` to the next empty line; one that no empty line
    ends is dropped.  Its thread count is the first token of the last ``threads`` line since
    the stack before it, null if there is none.
    """
    # What follows the last empty line is not ended.
    pieces = F.split(text, r"(?md)^\n", -1)
    closed = F.slice(pieces, 1, F.size(pieces) - 1)
    at = F.filter(F.transform(closed, lambda p, i: F.when(p.contains(start), i + 1)), lambda i: i.isNotNull())
    before = F.concat(F.array(F.lit(0)), at)
    count_line = rf"(?s).*(?:^|\n)([^\n]*\Q{threads}\E[^\n]*)"

    def one(last: Column, here: Column) -> Column:
        since = F.array_join(F.slice(closed, last + 1, here - last), "")
        line = F.regexp_extract(since, count_line, 1)
        stack = F.regexp_extract(F.get(closed, here - 1), rf"(?s)([^\n]*\Q{start}\E.*)", 1)
        return F.struct(
            F.regexp_replace(stack, "\n", "").alias("stack"),
            F.when(line != "", first_token(line)).alias("threads"),
        )

    return F.zip_with(F.slice(before, 1, F.size(at)), at, one)


def tagged_stack(stack: Column, threads: Column) -> Column:
    return F.concat(stack, F.lit(f" {COUNT_MARK} "), threads)


def places(c: Column, n: int) -> Column:
    """Number with ``n`` places, rounded as the exact binary value demands, ties to even."""
    return F.call_function("format_number", c, F.lit("0." + "0" * n))


def stat_value(line: Column, stat: str) -> Column:
    """Value after the ``<stat> Prediction Accuracy: `` label, null if the label is missing."""
    found = F.regexp_extract(line, rf"\Q{stat}\E Prediction Accuracy: (\S+)", 1)
    return F.when(found != "", to_number(found))


def closed_chunks(log: Column, mark: str = "Refreshing:") -> Column:
    """Texts between the mark lines of a whole log; what follows the last mark is not closed yet."""
    parts = F.split(log, rf"(?m)^\Q{mark}\E\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def with_blocks(df: DataFrame, column: str, is_mark: Callable[[Column], Column]) -> DataFrame:
    """Add ``blocks``: the lines of a text cut before every line that is a mark, in the row, without a shuffle."""
    lines = df.withColumn("lines", F.split(column, "\n", -1))
    marks = F.filter(F.transform("lines", lambda line, i: F.when(is_mark(line), i + 1)), lambda i: i.isNotNull())
    starts = lines.withColumn("starts", F.array_distinct(F.concat(F.array(F.lit(1)), marks)))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines") + 1))
    cut = F.zip_with("starts", ends, lambda s, e: F.slice(F.col("lines"), s, e - s))
    return starts.withColumn("blocks", cut).drop("lines", "starts")
