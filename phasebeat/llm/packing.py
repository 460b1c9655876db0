"""Sharding by vector bin packing.

Bytes, words and rows are balanced together.  Rows become at most a bounded number of placement units before
anything is placed: small groups of equal texts are bundled by a hash, a group that is larger than a small part
of a shard is a unit of its own, and one that is over half a shard is cut into pieces by a stored number of the row.  So the
driver places the same number of units whatever the size of the corpus, and a group that holds a third of
all rows is spread over shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasebeat.llm.common import bucket, n_bytes, n_words, text_of
from phasebeat.workspace import store

# Bytes that every document counts for besides its text.
OVERHEAD = 8
# Of the loads that are balanced, bytes weigh most: they are what the law speaks of.
LOADS = ("size", "words", "rows")
WEIGHTS = (4.0, 1.0, 1.0)


def place(loads: np.ndarray, n_shards: int, weights: tuple[float, ...] = WEIGHTS, repairs: int = 4000) -> np.ndarray:
    """The shard of each unit: largest first, to the shard whose residual capacity has the highest dot product with it.

    Afterwards moves and swaps between the fullest and the emptiest shard even out the first load.
    """
    total = loads.sum(axis=0)
    vectors = loads / np.where(total > 0, total, 1) * n_shards
    residual = np.ones((n_shards, loads.shape[1]))
    shard = np.zeros(len(loads), dtype=np.int32)
    weight = np.asarray(weights)
    for i in np.lexsort((np.arange(len(loads)), -(vectors * weight).sum(axis=1))):
        to = int(np.argmax(residual @ (vectors[i] * weight)))
        residual[to] -= vectors[i]
        shard[i] = to
    first = loads[:, 0]
    filled = np.bincount(shard, weights=first, minlength=n_shards)
    for _ in range(repairs):
        high, low = int(np.argmax(filled)), int(np.argmin(filled))
        gap = filled[high] - filled[low]
        ours, theirs = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
        if gap <= 1 or not len(ours):
            break
        # A move shifts the unit's size, a swap the difference of two; the best shift is half the gap.
        moved = first[ours]
        best = int(np.argmin(np.abs(moved - gap / 2)))
        gain, swap = abs(moved[best] - gap / 2), -1
        if len(theirs):
            other = np.sort(first[theirs])
            at = np.clip(np.searchsorted(other, moved - gap / 2), 0, len(other) - 1)
            for near in (at, np.maximum(at - 1, 0)):
                off = np.abs(moved - other[near] - gap / 2)
                if off.min() < gain:
                    best = int(np.argmin(off))
                    gain, swap = off[best], int(theirs[np.argsort(first[theirs], kind="stable")[near[best]]])
        if gain >= gap / 2:
            break
        one = int(ours[best])
        shift = first[one] - (first[swap] if swap >= 0 else 0)
        shard[one] = low
        if swap >= 0:
            shard[swap] = high
        filled[high] -= shift
        filled[low] += shift
    return shard


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, words, text_crc32, same, salt`` of each row, and ``keep`` under names that begin with ``_``.

    Equal texts have the same ``same``; ``salt`` tells repeated rows apart, so store the result before use.
    """
    text = text_of(docs)
    size = (n_bytes(text) + F.lit(OVERHEAD)).alias("size")
    crc = F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    same = F.xxhash64(text, F.octet_length(text)).alias("same")
    return docs.select("doc_id", size, n_words(text).alias("words"), crc, same, F.monotonically_increasing_id().alias("salt"), *[F.col(f"`{c}`").alias(f"_{c}") for c in keep])


def shards(
    docs: DataFrame, n_shards: int = 24, fine: int = 256, coarse: int = 64, slot_rows: int = 100_000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """A shard and a gapless slot for every row.

    ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the columns in ``keep``.  Null texts count as
    empty, null ids are a value like any other, repeated rows each get their own slot, an empty table gives none.
    Equal texts share a shard unless their group is over half a shard in some load; then its rows are dealt to pieces of
    that size.  Groups over 1/``coarse`` of a shard are units of their own, others are bundled, so at most
    ``n_shards`` x (``fine`` + 3 x ``coarse`` + 12) units are placed.
    """
    spark = docs.sparkSession
    rows = store(sizes(docs, keep), "sizes")
    loads = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    groups = rows.groupBy("same", "text_crc32").agg(*loads)
    total = rows.agg(*loads).first()
    part = F.greatest(*[F.col(c) * n_shards / F.lit(max(total[c] or 0, 1)) for c in LOADS])  # of a shard
    parts = F.when(part > 0.5, F.ceil(2 * part)).otherwise(1).cast("int").alias("parts")
    large = groups.where(part * coarse > 1).select("same", "text_crc32", parts)
    small = bucket(F.col("same"), n_shards * fine, 1).cast("long")
    # Fewer than 3 x n_shards x coarse groups can be over that part in one of three loads.
    piece = F.xxhash64("same", "text_crc32", bucket(F.col("salt"), F.col("parts"), 2))
    unit: Column = F.when(F.col("parts").isNull(), small).otherwise(piece)
    marked = rows.join(F.broadcast(large), ["same", "text_crc32"], "left").withColumn("unit", unit)
    found = marked.groupBy("unit").agg(*loads).orderBy("unit").collect()
    placed = place(np.array([[u[c] for c in LOADS] for u in found], dtype=float).reshape(-1, len(LOADS)), n_shards)
    pairs = [(u["unit"], int(s)) for u, s in zip(found, placed, strict=True)]
    units = spark.createDataFrame(pairs, "unit long, shard int")
    cells = max(64, -(-int(total["rows"]) // (slot_rows * n_shards)))
    cell = bucket(F.col("salt"), cells, 3)
    dealt = store(marked.join(F.broadcast(units), "unit").withColumn("cell", cell), "dealt")
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("start"))
    place_in = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "same", "salt"))
    numbered = dealt.withColumn("place", place_in).join(starts, ["shard", "cell"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"`_{c}`").alias(c) for c in keep],
    )
