"""Tables that cut the lineage of long plans, in the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a scratch folder only for local sessions without one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="phasebeat-")
    return _local_roots[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path that no other call gets; the writer creates it."""
    return f"{shared_root(spark)}/phasebeat/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Later steps read only the columns they need, keep statistics for join choices and do
    not depend on lost executors.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._phasebeat_stored = path
    return table


def drop(table: DataFrame) -> None:
    """Delete a table that ``store`` has written, once nothing reads it any more."""
    path = getattr(table, "_phasebeat_stored", None)
    if path:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is a table that ``store`` has just written, else written now."""
    return df if getattr(df, "_phasebeat_stored", None) else store(df, name)


def narrowed(table: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a table that ``store`` has written; it counts as written itself."""
    rows = table.select(*columns)
    rows._phasebeat_stored = getattr(table, "_phasebeat_stored", None)
    return rows
