"""Documents packed into chunks of some megabytes, and polynomial fingerprints of their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from phasebeat.llm.common import map_texts, mark_of, text_of

CHUNK_BYTES = 8 << 20
# Prefix sums are taken over blocks of so many bytes, which fit into a processor's cache.
BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2^64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
        done += more
    return out


def pack(parts: list[bytes]) -> tuple[bytes, int]:
    raw = b"".join(parts)
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True), len(raw)


def unpack(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=size, asbytes=True), np.uint8)


def chunks_of(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows ``chunk, ids, marks, lens, size, blob``: documents packed together, until a chunk is full.

    ``marks`` are fingerprints that tell texts of the same id apart.  Store the result before use: a
    chunk's number is that of the task that packed it.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        marks: list[int] = []
        parts: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            blob, size = pack(parts)
            columns = [
                pa.array([base + seq], pa.int64()),
                pa.array([ids], pa.list_(kind)),
                pa.array([marks], pa.list_(pa.int64())),
                pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                pa.array([size], pa.int64()),
                pa.array([blob], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "marks", "lens", "size", "blob"])

        for batch in batches:
            kind = batch["doc_id"].type
            for i, mark, text in zip(batch["doc_id"], batch["mark"], batch["text"].cast(pa.binary()), strict=True):
                ids.append(i.as_py())
                marks.append(mark.as_py())
                parts.append(text.as_py())
                held += len(parts[-1])
                if held >= chunk_bytes or len(ids) >= 1 << 16:
                    yield packed()
                    ids, marks, parts, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield packed()

    rows = docs.select("doc_id", mark_of(docs).alias("mark"), text_of(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, of, f"chunk long, ids array<{kind}>, marks array<long>, lens array<long>, size long, blob binary")
