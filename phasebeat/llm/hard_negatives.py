"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions.  The angle between two rows is at least the difference of
their angles to any reference and at most their sum, so each reference bounds their cosine; times both norms that bounds the score
from above and below.  A row is scored in integers only where this interval reaches into a window that an anchor still looks for.

Anchors are the query set.  Rows are packed into tiles and anchors into blocks; every tile meets every block, block after
block, and passes on only the few best rows of each anchor, which are then ranked over all tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasebeat.llm.centroids import complete, integers
from phasebeat.workspace import drop, store

TILE_ROWS = 32_768
BLOCK_ROWS = 512
# Pairs that are bounded at once, and pairs that are scored at once.
BOUNDED, SCORED = 1 << 20, 1 << 15
REFERENCES = 8
# Scores of rows up to this squared norm, five times over, fit into 63 bits.
LIMIT = 1 << 58
# What single precision and arc cosines near 0 and a half turn lose: of an angle in radians, of a product of norms.
SLACK, MARGIN = np.float32(1e-5), np.float32(1e-6)
NO_GOAL = np.iinfo(np.int64).min

PACKED = "uids binary, ids binary, no_id binary, labels binary, vectors binary, norms binary, angles binary, goals binary, width int"
FOUND = "anchor long, goal int, uid long, id long, no_id boolean, score long"


class Rows(NamedTuple):
    """Rows as arrays: numbers of their own, ids, whether the id is null, labels, integer vectors, norms, angles, sought scores."""

    uids: np.ndarray
    ids: np.ndarray
    no_id: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    goals: np.ndarray

    @classmethod
    def of(cls, uids: list, ids: list, labels: list, vectors: list, references: np.ndarray, goals: list | None = None) -> Rows:
        width = max(map(len, vectors), default=0)
        x = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        shared = min(width, references.shape[1])
        cosine = x[:, :shared] @ references[:, :shared].T / np.where(norms > 0, norms, 1)[:, None]
        return cls(
            np.array(uids, np.int64),
            np.array([0 if i is None else i for i in ids], np.int64),
            np.array([i is None for i in ids], bool),
            np.array(labels, np.int64),
            x,
            norms.astype(np.float32),
            np.arccos(np.clip(cosine, -1, 1)).astype(np.float32),
            np.array(goals if goals is not None else [[]] * len(uids), np.int64),
        )

    def record(self) -> dict:
        return {k: np.ascontiguousarray(v).tobytes() for k, v in self._asdict().items()} | {"width": self.vectors.shape[1]}

    @classmethod
    def unpacked(cls, r: dict) -> Rows:
        kinds = (np.int64, np.int64, bool, np.int64, np.int64, np.float32, np.float32, np.int64)
        arrays = [np.frombuffer(r[f], k) for f, k in zip(cls._fields, kinds, strict=True)]
        n = len(arrays[0])
        wide = {"vectors": r["width"], "angles": len(arrays[6]) // max(n, 1), "goals": len(arrays[7]) // max(n, 1)}
        return cls(*(a.reshape(n, wide[f]) if f in wide else a for f, a in zip(cls._fields, arrays, strict=True)))


def bounds(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds on the score of each pair, rounded outwards."""
    shape = (len(a.uids), len(b.uids))
    least, most = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for x, y in zip(a.angles.T, b.angles.T, strict=True):
        np.maximum(least, np.abs(x[:, None] - y), out=least)
        total = x[:, None] + y
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    least = np.maximum(least - SLACK, 0)
    most = np.minimum(most + SLACK, np.float32(np.pi))
    product = a.norms[:, None] * b.norms
    room = product * MARGIN + 1
    return product * np.cos(most) - room, product * np.cos(least) + room


def scores(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer scores of the pairs ``(i, j)``; a missing component is zero."""
    shared = min(a.vectors.shape[1], b.vectors.shape[1])
    x, y = a.vectors[:, :shared], b.vectors[:, :shared]
    cuts = range(0, len(i), SCORED)
    parts = [np.einsum("ij,ij->i", x[i[s : s + SCORED]], y[j[s : s + SCORED]]) for s in cuts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Best:
    """The first few rows of each list by score, id (null ids last) and number."""

    def __init__(self, n_lists: int, size: int):
        self.size = size
        self.rows = np.zeros(0, [("at", "i8"), ("score", "i8"), ("no_id", "?"), ("id", "i8"), ("uid", "i8")])
        self.least = np.full(n_lists, NO_GOAL)  # a full list's last score

    def add(self, at: np.ndarray, score: np.ndarray, b: Rows, j: np.ndarray) -> None:
        keep = score >= self.least[at]
        at, score, j = at[keep], score[keep], j[keep]
        more = np.zeros(len(at), self.rows.dtype)
        for name, column in (("at", at), ("score", score), ("no_id", b.no_id[j]), ("id", b.ids[j]), ("uid", b.uids[j])):
            more[name] = column
        rows = np.concatenate([self.rows, more])
        rows = rows[np.lexsort((rows["uid"], rows["id"], rows["no_id"], -rows["score"], rows["at"]))]
        starts = np.searchsorted(rows["at"], rows["at"])
        self.rows = rows[np.arange(len(rows)) - starts < self.size]
        last = np.arange(len(self.rows)) - np.searchsorted(self.rows["at"], self.rows["at"]) == self.size - 1
        self.least[self.rows["at"][last]] = self.rows["score"][last]


def positives_in(a: Rows, b: Rows, size: int) -> Best:
    """The best rows of the anchor's own label, for each anchor."""
    best = Best(len(a.uids), size)
    step = max(BOUNDED // max(len(a.uids), 1), 1)
    for start in range(0, len(b.uids), step):
        part = Rows(*(x[start : start + step] for x in b))
        low, high = bounds(a, part)
        mine = (a.labels[:, None] == part.labels) & (a.uids[:, None] != part.uids)
        # So many rows of the part reach this score that a row which cannot is not among the best.
        sure = np.where(mine, low, np.float32(-np.inf))
        kth = np.partition(sure, -size, axis=1)[:, -size] if sure.shape[1] >= size else np.full(len(a.uids), -np.inf, np.float32)
        i, j = np.nonzero(mine & (high >= np.maximum(kth, best.least)[:, None]))
        best.add(i, scores(a, part, i, j), part, j)
    return best


def negatives_in(a: Rows, b: Rows, size: int) -> Best:
    """The best rows of other labels within the window of each sought score; the lists are numbered anchor by anchor."""
    n_goals = a.goals.shape[1]
    best = Best(len(a.uids) * n_goals, size)
    least, most = -(-4 * a.goals // 5), a.goals
    step = max(BOUNDED // max(len(a.uids), 1), 1)
    for start in range(0, len(b.uids), step):
        part = Rows(*(x[start : start + step] for x in b))
        low, high = bounds(a, part)
        other = a.labels[:, None] != part.labels
        reach = np.zeros_like(other)
        for g in range(n_goals):
            sought = a.goals[:, g] != NO_GOAL
            floor = np.maximum(least[:, g], best.least[g::n_goals])
            reach |= sought[:, None] & (low <= most[:, g, None]) & (high >= floor[:, None])
        i, j = np.nonzero(other & reach)
        s = scores(a, part, i, j)
        for g in range(n_goals):
            fits = (a.goals[i, g] != NO_GOAL) & (s >= least[i, g]) & (s <= most[i, g])
            best.add(i[fits] * n_goals + g, s[fits], part, j[fits])
    return best


def references_of(rows: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of a few rows, those with the smallest hash of their vector; any directions give right bounds."""
    some = rows.select("x").where(F.exists("x", lambda v: v != 0)).orderBy(F.xxhash64("x"), "x").limit(n).collect()
    width = max((len(r["x"]) for r in some), default=1)
    found = np.zeros((max(len(some), 1), width))
    for i, r in enumerate(some):
        found[i, : len(r["x"])] = r["x"]
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1)


def _batch(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema)


def _packed_fields() -> list[pa.Field]:
    return [pa.field(f, pa.binary()) for f in Rows._fields] + [pa.field("width", pa.int32())]


def tiles_of(rows: DataFrame, references: np.ndarray, tile_rows: int) -> DataFrame:
    """``tile`` and packed rows; a row's number is that of the task that packed it, so store the result before use."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field("tile", pa.int64()), *_packed_fields()])
        base, done = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            uids = range(base + done, base + done + len(held))
            return _batch([{"tile": base + done} | Rows.of(uids, *zip(*held, strict=True), references).record()], schema)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("vec_id", "label", "x")), strict=True):
                held.append(row)
                if len(held) == tile_rows:
                    yield packed()
                    held, done = [], done + len(held)
        if held:
            yield packed()

    return rows.select("vec_id", "label", "x").mapInArrow(of, f"tile long, {PACKED}")


def anchors_of(tiles: DataFrame, every: int) -> DataFrame:
    """``anchor, id, label, x`` of the rows of ``tiles`` whose id is divisible by ``every``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                r = Rows.unpacked(record)
                at = np.flatnonzero(~r.no_id & (r.ids % every == 0))
                columns = [pa.array(r.uids[at]), pa.array(r.ids[at]), pa.array(r.labels[at]), pa.array(list(r.vectors[at]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "id", "label", "x"])

    return tiles.mapInArrow(of, "anchor long, id long, label long, x array<long>")


def blocks_of(anchors: DataFrame, references: np.ndarray, block_rows: int, n_goals: int) -> DataFrame:
    """Packed blocks of anchors, with the scores in ``goals`` if there are any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_packed_fields())
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                goals = [g + [NO_GOAL] * (n_goals - len(g)) for g in part["goals"].to_pylist()]
                columns = (part[c].to_pylist() for c in ("anchor", "id", "label", "x"))
                yield _batch([Rows.of(*columns, references, goals).record()], schema)

    return anchors.mapInArrow(of, PACKED)


def met(tiles: DataFrame, blocks: DataFrame, n_tiles: int, size: int) -> DataFrame:
    """What every anchor finds in every tile: ``anchor, goal, uid, id, no_id, score``, at most ``size`` rows per tile and goal.

    The goal is -1 for anchors that look for their positives.  Blocks are dealt to all tiles; a task holds one tile and one block.
    """
    kind = F.lit(0).alias("kind")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("slot")
    both = tiles.select("slot", kind, *Rows._fields, "width").unionByName(blocks.select(everywhere, F.lit(1).alias("kind"), *Rows._fields, "width"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            for at in range(batch.num_rows):
                record = batch.slice(at, 1).to_pylist()[0]
                rows = Rows.unpacked(record)
                if record["kind"] == 0:
                    tile = rows
                    continue
                n_goals = rows.goals.shape[1]
                found = negatives_in(rows, tile, size).rows if n_goals else positives_in(rows, tile, size).rows
                at_anchor, goal = (found["at"] // n_goals, found["at"] % n_goals) if n_goals else (found["at"], np.full(len(found), -1))
                columns = [rows.uids[at_anchor], goal.astype(np.int32), found["uid"], found["id"], found["no_id"], found["score"]]
                names = ["anchor", "goal", "uid", "id", "no_id", "score"]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    dealt = both.repartitionById(n_tiles, F.col("slot")).sortWithinPartitions("slot", "kind")
    return dealt.mapInArrow(of, FOUND)


def _named(kind: str) -> list[Column]:
    return [F.when(~F.col("no_id"), F.col("id")).alias(f"{kind}_id"), F.col("score").alias(f"{kind}_score")]


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    n_positives: int = 5,
    n_negatives: int = 5,
    scale: int = 256,
    n_labels: int = 10,
    shifted: int = 7,
    column: str = "embedding",
    n_references: int = REFERENCES,
    tile_rows: int = TILE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; a score is an inner product, in which a missing component counts as zero.  Where the id is
    divisible by ``shifted``, the label becomes the next of ``n_labels``.  Anchors are rows whose id is divisible by ``every``; positives
    are an anchor's best ``n_positives`` other rows of its label, negatives the best ``n_negatives`` rows of other labels that score
    at least 80 % of the positive and no more than it.  Equal scores are ordered by id, null ids last, then by row.

    Rows with a null label, a null vector, or a null, NaN or infinite component take no part.  Repeated rows are rows of their own, as
    anchors too.  Anchors without positives, and positives without negatives, give no rows; an empty table gives none.  A row
    whose squared norm is 2^58 or more is an error, since scores would not fit.

    Every anchor meets every row, so the work grows with the square of the input; a task holds ``tile_rows`` rows and ``block_rows`` anchors.
    """
    spark = vectors.sparkSession
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label")).cast("long")
    x = F.col(f"`{column}`")
    rows = vectors.where(F.col("label").isNotNull() & complete(x))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), integers(x, scale).alias("x"))
    norm = F.aggregate(rows["x"], F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    too_long = F.raise_error(F.lit("a vector is too long for scores in 64 bits")).cast("array<bigint>")
    rows = rows.withColumn("x", F.when(norm < F.lit(float(LIMIT)), F.col("x")).otherwise(too_long))
    references = references_of(rows, n_references)
    tiles = store(tiles_of(rows, references, tile_rows), "tiles")
    # Tiles get numbers without gaps; there is one narrow row per tile.
    slots = tiles.select("tile").withColumn("slot", F.row_number().over(Window.orderBy("tile")) - 1)
    slots = store(slots, "slots")
    n_tiles = slots.count()
    if not n_tiles:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    numbered = tiles.join(slots, "tile")
    anchors = store(anchors_of(tiles, every), "anchors")
    order = [F.col("score").desc(), "no_id", "id", "uid"]

    nothing = F.array().cast("array<long>").alias("goals")
    blocks = blocks_of(anchors.select("*", nothing), references, block_rows, 0)
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    ranked = met(numbered, blocks, n_tiles, n_positives).withColumn("rank", first).where(F.col("rank") <= n_positives)
    positives = store(ranked.select("anchor", (F.col("rank") - 1).alias("goal"), *_named("positive")), "positives")

    # At most n_positives rows of each anchor meet here.
    in_order = F.sort_array(F.collect_list(F.struct("goal", "positive_score")))
    goals = positives.groupBy("anchor").agg(F.transform(in_order, lambda g: g["positive_score"]).alias("goals"))
    blocks = blocks_of(anchors.join(goals, "anchor"), references, block_rows, n_positives)
    rank = F.row_number().over(Window.partitionBy("anchor", "goal").orderBy(*order))
    ranked = met(numbered, blocks, n_tiles, n_negatives).withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    negatives = store(ranked.select("anchor", "goal", "rank", *_named("negative")), "negatives")
    drop(tiles)
    drop(slots)
    named = anchors.select("anchor", F.col("id").alias("anchor_id")).join(positives, "anchor")
    return negatives.join(named, ["anchor", "goal"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
