"""Benchmark decontamination by suffix arrays over the training text.

Every chunk of documents gets a suffix array over its words.  Every suffix of every benchmark item is searched in it by
bisection: equal words, then equal pairs, fours and eights of words are looked up among the sorted names of the chunk,
and the ten words of a window by two of those.  The range that is found holds all occurrences; ranges of different
windows never overlap, so a range is looked at once, however often its window is repeated in the items.  How far a match goes on is
read from the neighbours of its start among the sorted suffixes of what was hit and of the items.

The benchmark is the query set: its items are packed into blocks and written beside the chunks, and every chunk meets every block.
A chunk's array is built once for all blocks that follow one another.  No task holds more than a chunk and a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.chunks import CHUNK_BYTES, chunks_of, pack, unpack
from phasebeat.llm.common import text_of
from phasebeat.llm.wordnames import WordNames, words_by_text
from phasebeat.workspace import drop, store

WINDOW = 10
ITEM_BLOCK_BYTES = 4 << 20
# A text's items are gathered so many at a time.
ITEMS_AT_ONCE = 1 << 20
# Lengths of matches are read for so many places at a time.
PLACES_AT_ONCE = 1 << 18


class SuffixArray:
    """Positions of a text of names, sorted by the first ten names from there on."""

    def __init__(self, names: np.ndarray):
        self.levels = []
        ranks = names
        by_width = {}
        for width in (1, 2, 4, 8):
            keys = names if width == 1 else self._pairs(ranks, width // 2)
            distinct, ranks = np.unique(keys, return_inverse=True)
            # Ranks take 32 bits, and no more of them are held than are joined below.
            ranks = ranks.astype(np.int32)
            self.levels.append(distinct)
            if width != 4:
                by_width[width] = ranks
            del keys
        self.words = by_width[1]
        keys = self._joined(by_width[8], by_width[2], 8)
        del by_width, ranks
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    @staticmethod
    def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        out = left.astype(np.int64) << 32
        out[: max(len(left) - shift, 0)] += right[shift:] + 1
        return out

    def _pairs(self, ranks: np.ndarray, shift: int) -> np.ndarray:
        return self._joined(ranks, ranks, shift)

    def windows(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the ten names from each position of a query on, the range of ``order`` that has them; empty if none."""
        n = len(names)
        ranks, by_width = None, {}
        for width, distinct in zip((1, 2, 4, 8), self.levels, strict=True):
            if width == 1:
                keys, known = names, names > 0
            else:
                half = width // 2
                keys, known = np.full(n, -1, np.int64), np.zeros(n, bool)
                if n > half:
                    known[:-half] = (ranks[:-half] >= 0) & (ranks[half:] >= 0)
                    keys[:-half] = (ranks[:-half] << 32) + ranks[half:] + 1
            at = np.searchsorted(distinct, keys)
            at[at == len(distinct)] = 0
            found = known & (distinct[at] == keys) if len(distinct) else np.zeros(n, bool)
            ranks = np.where(found, at, -1)
            by_width[width] = ranks
        keys = np.full(n, -1, np.int64)
        if n > 8:
            both = (by_width[8][:-8] >= 0) & (by_width[2][8:] >= 0)
            keys[:-8] = np.where(both, (by_width[8][:-8] << 32) + by_width[2][8:] + 1, -1)
        return np.searchsorted(self.keys, keys, "left"), np.where(keys < 0, 0, np.searchsorted(self.keys, keys, "right"))

    def prefix(self, names: np.ndarray) -> tuple[int, int]:
        """The range of ``order`` whose suffixes begin with up to ten names, bisected word by word."""
        lo, hi = 0, len(self.order)
        for k, name in enumerate(names):
            rank = int(np.searchsorted(self.levels[0], name))
            if rank == len(self.levels[0]) or self.levels[0][rank] != name:
                return 0, 0

            def edge(left: int, right: int, beyond: int, k: int = k) -> int:
                while left < right:
                    mid = (left + right) // 2
                    at = self.order[mid] + k
                    if (self.words[at] if at < len(self.words) else -1) < beyond:
                        left = mid + 1
                    else:
                        right = mid
                return left

            lo, hi = edge(lo, hi, rank), edge(lo, hi, rank + 1)
        return lo, hi


def _spread(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``lows``, one after another."""
    return np.repeat(lows - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _runs(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` in the order of ``at`` with a zero behind each run of neighbouring places, and the place of each."""
    order = np.argsort(at, kind="stable")
    at, values = at[order], values[order]
    ends = np.flatnonzero(np.diff(at, append=at[-1:] + 2) != 1) + 1
    return np.insert(values, ends, 0), np.insert(at, ends, -1)


def longest_common(text: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``text`` the longest common run with any place of ``query``, and that place.

    Zeros separate runs in both.  All suffixes are sorted together by doubling; the longest run is shared with the nearest suffix of the
    query before or after, and its length is read from the names of each doubling.
    """
    both = np.concatenate([text, query]).astype(np.int32)
    n = len(both)
    zeros = np.flatnonzero(both == 0)
    left = np.repeat(zeros, np.diff(zeros, prepend=-1)).astype(np.int32) - np.arange(n, dtype=np.int32)
    cap = int(min(left[: len(text)].max(), left[len(text) :].max()))
    names, levels, width = both, [both], 1
    while width < cap:
        keys = names.astype(np.int64) << 32
        keys[:-width] += names[width:]
        distinct, names = np.unique(keys, return_inverse=True)
        names = names.astype(np.int32)
        levels.append(names)
        width *= 2
        if len(distinct) == n:
            break
    order = np.argsort(names, kind="stable").astype(np.int32)
    del names
    mine = order < len(text)
    rank = np.arange(n, dtype=np.int32)
    before = np.maximum.accumulate(np.where(mine, np.int32(-1), rank))[mine]
    behind = np.minimum.accumulate(np.where(mine, np.int32(n), rank)[::-1])[::-1][mine]
    place = order[mine]
    length, at = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
    for cut in range(0, len(place), PLACES_AT_ONCE):
        part = slice(cut, cut + PLACES_AT_ONCE)
        for near, known in ((before[part], before[part] >= 0), (behind[part], behind[part] < n)):
            a, b = place[part][known].astype(np.int64), order[near[known]].astype(np.int64)
            run = np.zeros(len(a), np.int64)
            for k in range(len(levels) - 1, -1, -1):
                x, y = a + run, b + run
                inside = np.maximum(x, y) < n
                same = levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)]
                run += np.where(inside & same, 1 << k, 0)
            run = np.minimum(run, np.minimum(left[a], left[b]))
            better = run > length[a]
            length[a[better]], at[a[better]] = run[better], b[better] - len(text)
    return length, at


class Hits:
    """All occurrences of the windows of items in the text of an array, and of whole items shorter than a window."""

    def __init__(self, array: SuffixArray, items: list[np.ndarray], window: int = WINDOW):
        self.window, self.n_items = window, len(items)
        sizes = np.array([len(x) + 1 for x in items], np.int64)
        self.firsts = np.cumsum(sizes) - sizes
        self.item_of = np.repeat(np.arange(len(items)), sizes)
        flat = np.concatenate([np.append(x, np.uint64(0)) for x in items]) if items else np.empty(0, np.uint64)
        low, high = array.windows(flat)
        self.query = np.flatnonzero(high > low)
        # Equal windows have one range, different ones share no place.
        lows, one, kind = np.unique(low[self.query], return_index=True, return_inverse=True)
        n = high[self.query][one] - lows
        self.query_kind, self.n_kinds = kind + 1, len(lows)
        self.place = array.order[_spread(lows, n)]
        self.place_kind = np.repeat(np.arange(1, len(lows) + 1, dtype=np.int32), n)
        short = [(i, *array.prefix(x)) for i, x in enumerate(items) if 0 < len(x) < window]
        short = [(i, lo, hi) for i, lo, hi in short if lo < hi]
        self.short = [(i, array.order[lo:hi], len(items[i])) for i, lo, hi in short]

    def matches(self) -> Iterator[tuple[np.ndarray, ...]]:
        """``item, start, item start, words``: from each start the longest verbatim match, unless it is the rest of the one before."""
        if len(self.place):
            text, start = _runs(self.place, self.place_kind)
            query, at = _runs(self.query, self.query_kind)
            run, found = longest_common(text, query)
            kept = (text > 0) & (run >= np.append(0, run[:-1]))
            q = at[found[kept]]
            item = self.item_of[q]
            yield item, start[kept], q - self.firsts[item], run[kept] + self.window - 1
        for i, place, n in self.short:
            yield np.full(len(place), i), place, np.zeros(len(place), np.int64), np.full(len(place), n)

    def items_by_text(self, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The items of each text that has any; texts begin at ``firsts``."""

        def by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = int(values.max(initial=0)) + 1
            pairs = np.unique(keys.astype(np.int64) * top + values)
            return pairs // top, pairs % top

        kinds, item = by(self.query_kind - 1, self.item_of[self.query])
        from_, to = np.searchsorted(kinds, np.arange(self.n_kinds)), np.searchsorted(kinds, np.arange(self.n_kinds), "right")
        texts, kind = by(np.searchsorted(firsts, self.place, "right") - 1, self.place_kind - 1)
        small = [(np.searchsorted(firsts, place, "right") - 1, np.full(len(place), i)) for i, place, _ in self.short]
        more, small_item = by(*map(np.concatenate, zip(*small, strict=True))) if small else (texts[:0], texts[:0])
        for d in np.union1d(texts, more).tolist():
            seen = np.zeros(self.n_items, bool)
            seen[small_item[np.searchsorted(more, d) : np.searchsorted(more, d, "right")]] = True
            of = kind[np.searchsorted(texts, d) : np.searchsorted(texts, d, "right")]
            sizes = to[of] - from_[of]
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(sizes) // ITEMS_AT_ONCE)) + 1):
                seen[item[_spread(from_[of[part]], sizes[part])]] = True
            yield d, np.flatnonzero(seen)


def matches(array: SuffixArray, items: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Maximal verbatim matches ``item, start, item start, words`` of items in the text, of a window's length or more."""
    return Hits(array, items, window).matches()


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """Items packed into blocks of about so many bytes, equal texts in one block; one empty block if there are none."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("doc_id"), text_of(benchmark).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartition(size // block_bytes + 1, F.xxhash64("text"))
    packed = chunks_of(dealt, block_bytes)
    spark = benchmark.sparkSession
    if benchmark.isEmpty():
        packed = spark.createDataFrame([(0, [], [], [], 0, pack([])[0])], packed.schema)
    names = {"chunk": "block", "ids": "item_ids", "lens": "item_lens", "size": "item_size", "blob": "item_blob"}
    return store(packed.drop("marks").withColumnsRenamed(names), "items")


class _Block:
    """The items of a block: the words of each distinct one and its ids."""

    def __init__(self, row: dict, names: WordNames):
        flat, firsts = words_by_text(unpack(row["item_blob"], row["item_size"]), row["item_lens"], names)
        by_text: dict[bytes, list[str]] = {}
        for i, s, e in zip(row["item_ids"], firsts.tolist(), np.append(firsts, len(flat))[1:].tolist(), strict=True):
            by_text.setdefault(flat[s : e - 1].tobytes(), []).extend([] if i is None else [i])
        self.number = row["block"]
        self.words = [np.frombuffer(x, np.uint64) for x in by_text]
        self.ids = list(by_text.values())


class _Chunk:
    """The documents of a chunk and the suffix array of their words."""

    def __init__(self, row: dict, names: WordNames):
        flat, self.firsts = words_by_text(unpack(row["blob"], row["size"]), row["lens"], names)
        self.number = row["chunk"]
        self.n_flat = len(flat)
        self.n_words = np.diff(np.append(self.firsts, len(flat))) - 1
        self.array = SuffixArray(flat)

    def search(self, block: _Block) -> dict[int, tuple[list[dict], list[str], int]]:
        """Hit runs, ids of items and longest match of each document that has a match."""
        hits = Hits(self.array, block.words)
        edges, longest = np.zeros(self.n_flat + 1, np.int32), np.zeros(len(self.firsts), np.int64)
        for _, place, _, size in hits.matches():
            np.add.at(edges, place, 1)
            np.add.at(edges, place + size, -1)
            np.maximum.at(longest, np.searchsorted(self.firsts, place, "right") - 1, size)
        turns = np.flatnonzero(np.diff(np.cumsum(edges) > 0, prepend=False))
        starts, ends = turns[::2], turns[1::2]
        of = np.searchsorted(self.firsts, starts, "right") - 1
        found = {}
        for d, items in hits.items_by_text(self.firsts):
            some = slice(np.searchsorted(of, d), np.searchsorted(of, d, "right"))
            first = self.firsts[d]
            spans = [{"s": s, "e": e} for s, e in zip((starts[some] - first).tolist(), (ends[some] - first).tolist(), strict=True)]
            found[d] = spans, sorted({x for k in items.tolist() for x in block.ids[k]}), int(longest[d])
        return found


def contamination(
    docs: DataFrame, benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES, item_block_bytes: int = ITEM_BLOCK_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, spans, items, mark`` of every row.

    A word is hit if it lies in ten consecutive words that an item has too, or in a whole item of fewer words.  ``spans`` are
    the hit runs (first word, end exclusive), ``longest`` is the longest verbatim match in words, ``items`` the ids as strings.
    Null texts have no words; items without words or an id match nothing or have no name.  Repeated rows and
    items are handled one by one.  An empty table gives no rows, an empty benchmark no hits.
    """
    chunks = store(chunks_of(docs, chunk_bytes), "chunks")
    blocks = _item_blocks(benchmark, item_block_bytes)
    first, n_blocks = blocks.agg(F.min("block"), F.count("*")).first()
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    columns = f"chunk long, place int, doc_id {kind}, mark long, n_words long, spans array<struct<s: long, e: long>>, items array<string>, longest long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        chunk, block = None, None
        for batch in batches:
            id_type = batch["ids"].type.value_type
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if chunk is None or chunk.number != row["chunk"]:
                    chunk = None  # or two arrays are held while the next one is built
                    chunk = _Chunk(row, names)
                if block is None or block.number != row["block"]:
                    block = _Block(row, names)
                found = chunk.search(block)
                rows = []
                for d, (i, mark, n) in enumerate(zip(row["ids"], row["marks"], chunk.n_words.tolist(), strict=True)):
                    if d in found or block.number == first:  # a document without a hit is passed on once
                        rows.append((chunk.number, d, i, mark, n, *found.get(d, ([], [], 0))))
                span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                types = [pa.int64(), pa.int32(), id_type, pa.int64(), pa.int64(), span, pa.list_(pa.string()), pa.int64()]
                fields = ["chunk", "place", "doc_id", "mark", "n_words", "spans", "items", "longest"]
                parts = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, types, strict=True)], fields)

    # The query set in blocks against all chunks; rows are chunks of some megabytes, not documents.
    rows = store(chunks.crossJoin(blocks).mapInArrow(search, columns), "matches")
    drop(chunks)
    drop(blocks)
    if n_blocks == 1:
        return _summary(rows)
    # One document's spans and items over all blocks, then the same summary as for one block.
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<s: long, e: long>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["e"] >= x["s"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    kept = [F.max(c).alias(c) for c in ("doc_id", "mark", "n_words", "longest")]
    return _summary(rows.groupBy("chunk", "place").agg(*kept, merged.alias("spans"), items.alias("items")))


def _summary(rows: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
        "spans",
        "items",
        "mark",
    )
