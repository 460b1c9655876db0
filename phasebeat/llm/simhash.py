"""Near-duplicates by SimHash with covering locality-sensitive hashing.

Every fingerprint bit gets a vector of radius + 1 bits; a table keeps the fingerprint bits whose vectors have an odd
product with the table's own vector.  The vectors of at most ``radius`` differing bits cannot span the whole space, so some
table has an even product with all of them and keeps none of them: each pair within the radius meets in some table, not
just with high probability.

Documents with the same fingerprint are one class from the start, tables hold classes.  Buckets are linked by trees that a
search finds, not by pairs.  A bucket that is too large for one task is dealt again by a second family of tables, and
what is still too large by pairs of tiles.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.common import map_texts, mark_of, text_of
from phasebeat.llm.components import components
from phasebeat.workspace import store

SEED = 42
WORDS_PER_SHINGLE = 4
RADIUS = 4
BITS = 64
# Classes that one task links at once.
BUCKET = 4096
FAMILIES = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BIT_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None) -> int:
    """The SimHash of a text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < WORDS_PER_SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - WORDS_PER_SHINGLE + 1
        shingles = map(b" ".join, zip(*[islice(words, k, None) for k in range(WORDS_PER_SHINGLE)], strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(2048, dtype=np.int64)
    for _ in range(0, n, 1 << 16):  # long texts in pieces
        piece = np.fromiter(islice(hashes, 1 << 16), dtype="<u8")
        ones += np.bincount((piece.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048)
    counts = (ones.reshape(8, 256) @ _BIT_OF).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, fp`` of every row; ``mark`` tells texts of the same id apart."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((fingerprint(t.as_py()) for t in batch["text"]), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], found], ["doc_id", "mark", "fp"])

    rows = docs.select("doc_id", mark_of(docs).alias("mark"), text_of(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, of, f"doc_id {kind}, mark long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS, seed: int = 0) -> list[int]:
    """The 2^(radius + 1) - 1 masks of a covering family, as signed numbers; a seed gives another family."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    found = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, vector in enumerate(vectors) if (vector & v).bit_count() % 2)
        found.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return found


def tree(values: np.ndarray, radius: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the same values as all pairs within the radius would, found by a search from value to value.

    With ``left`` (booleans) only pairs between the two sides count.
    """
    rest, links = np.arange(len(values)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= radius
            if left is not None:
                near &= left[rest] != left[at]
            if near.any():
                found = rest[near]
                links.extend((int(at), int(x)) for x in found)
                queue.extend(found)
                rest = rest[~near]
    return links


def _link(grouped: DataFrame, radius: int) -> DataFrame:
    """Links in each row's list ``fps``, of two sides where ``left`` is not null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for fps, left in zip(batch["fps"], batch["left"], strict=True):
                values = np.asarray(fps.values, dtype=np.int64)
                sides = None if not left.is_valid else np.asarray(left.values.to_numpy(zero_copy_only=False), dtype=bool)
                for a, b in tree(values.view(np.uint64), radius, sides):
                    u.append(int(values[a]))
                    v.append(int(values[b]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return grouped.mapInArrow(of, "u long, v long")


def _keyed(rows: DataFrame, radius: int, family: int) -> DataFrame:
    """Each row once per table of a family, its key extended by the table and what the table keeps."""
    tables: list[Column] = [
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius, seed=family))
    ]
    dealt = rows.select("fp", "key", F.explode(F.array(*tables)).alias("e"))
    return dealt.select("fp", F.xxhash64("key", "e.t", "e.k").alias("key"))


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, families: int = FAMILIES) -> DataFrame:
    """Links ``u, v`` between the distinct values ``fp``, enough to join all that differ in at most ``radius`` bits."""
    rows = classes.select("fp", F.lit(0).cast("long").alias("key"))
    found = []
    for family in range(families):
        keyed = _keyed(rows, radius, family)
        counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # Spark sizes the dealt rows as if each were dealt once, so it would broadcast them all.
        met = store(keyed.join(counted.hint("merge"), "key"), "met")
        small = met.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
        found.append(_link(small.select("fps", F.lit(None).cast("array<boolean>").alias("left")), radius))
        rows = met.where(F.col("n") > bucket).select("fp", "key", "n")
        if rows.isEmpty():
            break
    else:
        # Tiles: a class meets every tile of its bucket, in one group per pair of tiles.
        half = bucket // 2
        n_tiles = F.ceil(F.col("n") / half).cast("int")
        tiled = rows.withColumn("n_tiles", n_tiles).withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(9)), F.col("n_tiles")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))
        paired = tiled.withColumn("other", other).select(
            "key", "fp", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") <= F.col("other")).alias("left")
        )
        grouped = paired.groupBy("key", "a", "b").agg(F.collect_list(F.struct("fp", "left")).alias("x"))
        sides = F.when(F.col("a") != F.col("b"), F.col("x.left"))
        found.append(_link(grouped.select(F.col("x.fp").alias("fps"), sides.alias("left")), radius))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id, mark, kept`` of every row.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; a component has the smallest document id that is
    reachable.  Null and blank texts have the fingerprint zero and are linked like any other.  ``kept`` marks the first row of each
    component by id (null ids last) and text; rows with the same id and text are one document, kept together.
    A component whose ids are all null has a null id.  An empty table gives no rows.
    """
    rows = store(fingerprints(docs), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    classes = store(rows.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    roots = components(links(classes, radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    by_fp = named.join(least, "root").select("fp", "least")
    done = rows.join(by_fp, "fp")
    return done.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        "mark",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))).alias("kept"),
    )
