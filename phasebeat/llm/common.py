"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words, as the query contracts state it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows go to Python in Arrow batches of about so many bytes; Spark's own limits are 10,000 rows or 64 MB, which both sides of each task hold.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` for rows with whole texts, in small batches.  The limit is the session's; one that the caller has set is kept."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return rows.mapInArrow(of, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> Column:
    """The text as a string, empty where it is null."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def bucket(key: Column, n: int | Column, *salt: int) -> Column:
    """A number from 0 to ``n`` - 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(key, *[F.lit(s) for s in salt]), n if isinstance(n, Column) else F.lit(n)).cast("int")


def mark_of(df: DataFrame, *salt: int) -> Column:
    """A fingerprint of the text, which tells rows of the same id apart."""
    return F.xxhash64(*[F.lit(x) for x in salt], text_of(df))


def joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with rows ``doc_id, mark`` (and more, unless ``how`` only filters); null ids equal each other.

    Columns of ``docs`` may have any names: they travel in one struct ``_row``.  The rows are never broadcast: Spark knows the bytes
    of their compressed texts only.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), mark_of(docs).alias("_mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    if how == "inner":
        rows = rows.hint("merge")
    return rows.join(keys, F.col("_id").eqNullSafe(keys["doc_id"]) & (F.col("_mark") == keys["mark"]), how)
