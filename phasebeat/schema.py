"""Schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

SAMPLES = _struct(cluster=_S, worker=_S, tick=_L, resource_data=_S, threaddump_data=T.ArrayType(_S))
TIMED_SAMPLES = _struct(cluster=_S, worker=_S, ts=_TS, resource_data=_S, threaddump_data=T.ArrayType(_S))
WORKERS = _struct(cluster=_S, worker=_S)
PROCESSES = _struct(host=_S, pid=_L, ppid=_L, cpu=_D, mem=_D)
MAIN_PROCESSES = _struct(host=_S, pid=_L)
WORKLOAD_LOG = _struct(ts=_L, pid=_L)
# The same over many workers, and what names a process there.
WORKER_LOG = _struct(cluster=_S, worker=_S, ts=_L, pid=_L)
PROCESS = ("cluster", "worker", "pid")
