"""Reading worker samples, resource lines, dumps and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasebeat import schema
from phasebeat.functions import text


def read_samples(spark: SparkSession, path: str, sample_schema: T.StructType = schema.SAMPLES) -> DataFrame:
    """One JSON object per worker and sample."""
    return spark.read.schema(sample_schema).json(path)


def stream_samples(
    spark: SparkSession, path: str, sample_schema: T.StructType = schema.TIMED_SAMPLES, **options: str
) -> DataFrame:
    return spark.readStream.schema(sample_schema).options(**options).json(path)


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Aggregated thread dumps, a file per row: ``(path, value)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of logs as they arrive, each file whole: ``(path, written, value)``."""
    stream = spark.readStream.schema("value string").text(path, wholetext=True)
    written = F.col("_metadata.file_modification_time").alias("written")
    return stream.select(F.col("_metadata.file_path").alias("path"), written, "value")


def read_resource_history(spark: SparkSession, path: str) -> DataFrame:
    """``cluster,worker,pid,count,cpu,mem`` lines; one without a number has null there."""
    fields = F.split("value", ",", -1)
    named = [F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(schema.PROCESS)]
    numbers = [text.to_number(F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(("count", "cpu", "mem"), len(named))]
    rows = spark.read.text(path).select(*named, *numbers)
    return rows.withColumns({"pid": F.col("pid").cast("long"), "count": F.col("count").cast("long")})


def read_workload_log(spark: SparkSession, path: str, log_schema: T.StructType = schema.WORKLOAD_LOG) -> DataFrame:
    return spark.read.schema(log_schema).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their number in the file: ``(path, line_no, line)``, numbered from 0.

    A file may be larger than a task can hold.  Lines are counted per block of the file, the counts
    are carried over the blocks, and only the numbering of a block is a window.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("path", "block").orderBy("row")) - 1
    numbered = lines.withColumn("inside", inside).join(starts, ["path", "block"])
    return numbered.select("path", (F.col("first") + F.col("inside")).alias("line_no"), "line")
