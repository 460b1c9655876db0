"""Repeated passages by suffixes sampled with a difference cover.

Every byte that lies in a string of ``length`` bytes which starts anywhere else too is removed.  Positions are sampled whose residue
belongs to a difference cover: for any two positions there is a shift, below the cover's period, after which both are
sampled.  So two equal strings of ``length`` bytes contain two sampled suffixes with an equal prefix of ``length - period + 1`` bytes.

1. Sampled suffixes get names for that prefix, sorted name lists are merged bucket by bucket, and adjacent equal names are found.
2. The remaining suffixes are merged in only where a sampled one close by has an equal.  They are named by ``length`` bytes, sorted,
   and compared with their neighbours in the same way.

Order beyond ``length`` bytes cannot change the answer, so names are fingerprints of prefixes and the recursion on names ends there.
Names of whole strings have 64 bits; a wrong match needs two different candidates with the same name.

Documents travel in chunks of some megabytes.  A chunk sends each name once, however often it holds it, and gets back
one bit per name.  So a passage that a third of all documents share costs one name per chunk.  Of equal
texts one supports the others, the rest are done once their equality is known.

On request the same two steps run over words as well, whose fingerprints are the symbols then.  They count the words in passages that
another document has too; a passage counted in words may have far fewer than ``length`` bytes, so nothing of it need be removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.chunks import BASE, BLOCK, CHUNK_BYTES, chunks_of, pack, powers, unpack
from phasebeat.workspace import drop, store

LENGTH = 400
# Passages of over 50 words are counted, whatever their length in bytes.
PASSAGE_WORDS = 51
BUCKET_BYTES = 4 << 20
# Only sizes buckets and names: a word with its space has about so many bytes.
WORD_BYTES = 6
SPARE_BITS = 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def difference_cover(power: int) -> tuple[int, list[int]]:
    """Period q^2 + q + 1 and the q + 1 residues of Singer's difference set, for q = 2 ** ``power``.

    Powers of a generator of the field of q^3 elements whose trace over the field of q elements is zero.
    """
    q, degree = 2**power, 3 * power
    order = 2**degree - 1

    def multiply(a: int, b: int, modulus: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1, b >> 1
            if a >> degree:
                a ^= modulus
        return out

    for modulus in range(2**degree + 1, 2 ** (degree + 1), 2):
        powers, x = [], 1
        for _ in range(order):
            powers.append(x)
            x = multiply(x, 2, modulus)
            if x == 1:
                break
        if len(powers) == order:  # x generates the field
            break

    def raised(e: int) -> int:
        return powers[e % order]

    period = q * q + q + 1
    return period, [e for e in range(period) if raised(e) ^ raised(e * q) ^ raised(e * q * q) == 0]


def cover_for(length: int) -> tuple[int, list[int]]:
    """The largest of these covers whose period leaves a prefix of about a third of the length."""
    power = max((p for p in range(1, 5) if 4**p + 2**p + 1 <= 0.7 * length), default=0)
    return difference_cover(power) if power else (1, [0])


@dataclass(frozen=True)
class Sampling:
    """Which suffixes are named first for strings of ``length`` symbols, by how many symbols, and how many buckets the names get."""

    length: int
    period: int
    residues: list[int]
    low_bits: np.uint64
    buckets: int

    @property
    def width(self) -> int:
        return self.length - self.period + 1


def sampling_for(length: int, n_symbols: int) -> Sampling:
    period, residues = cover_for(length)
    n_names = int(n_symbols * len(residues) / period)
    # Sampled suffixes only point to candidates: at any size, names this long make one in 2^16 a wrong one.
    low_bits = np.uint64(max(0, 64 - SPARE_BITS - n_names.bit_length()))
    return Sampling(length, period, residues, low_bits, max(1, -(-n_names * 8 // BUCKET_BYTES)))


def _codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(found: np.ndarray) -> np.ndarray:
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    found *= np.uint64(0x94D049BB133111EB)
    found ^= found >> np.uint64(31)
    return found


class Names:
    """Fingerprints of all strings of ``width`` bytes in a text, by prefix sums of a polynomial in each block.

    ``of`` takes the fingerprints of words in place of bytes as well.
    """

    def __init__(self, width: int):
        self.width = width
        self.up = powers(BASE, BLOCK + width)
        self.down = powers(pow(BASE, -1, 2**64), BLOCK)
        self.code = _codes(20)

    def of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Names at the sorted positions ``starts``."""
        out = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo == hi:
                continue
            base = b * BLOCK + int(starts[lo] - b * BLOCK)
            at = starts[lo:hi] - base
            part = data[base : base + int(at[-1]) + self.width]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((self.code[part] if part.dtype == np.uint8 else part) * self.up[: len(part)], out=sums[1:])
            out[lo:hi] = _mixed((sums[at + self.width] - sums[at]) * self.down[at])
        return out


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class Words:
    """Fingerprints of words, the runs of bytes between white space, in texts that lie one after another."""

    def __init__(self):
        self.up = powers(BASE, BLOCK)
        self.down = powers(pow(BASE, -1, 2**64), BLOCK)
        self.code = np.where(_SPACE, np.uint64(0), _codes(21))

    def of(self, data: np.ndarray, lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The words' fingerprints; before how many of them each text begins, and the number of all."""
        begins = np.cumsum([0, *lens])
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = begins[begins < len(data)]
        first[heads] = inside[heads]
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(data))  # white space behind a word adds nothing to its sum
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            base = int(starts[lo])
            hi = int(np.searchsorted(stops, base + BLOCK, "right"))
            if hi > lo:
                at = starts[lo:hi] - base
                part = data[base : stops[hi - 1]]
                out[lo:hi] = np.add.reduceat(self.code[part] * self.up[: len(part)], at) * self.down[at]
            else:
                hi = lo + 1
                out[lo] = self._long(data[base : stops[lo]])
            lo = hi
        return _mixed(out), np.searchsorted(starts, begins)

    def _long(self, part: np.ndarray) -> np.uint64:
        total = 0
        for k in range(0, len(part), BLOCK):
            piece = self.code[part[k : k + BLOCK]]
            total += int((piece * self.up[: len(piece)]).sum()) * pow(BASE, k, 2**64)
        return np.uint64(total % 2**64)


def _bucket_cuts(names: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of names begins in a sorted list."""
    edges = np.array([(k << 64) // n for k in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(names, edges), len(names))


def _encoded(names: np.ndarray) -> bytes:
    """Sorted names as steps, by byte planes: the high planes are nearly empty and vanish in compression."""
    steps = np.diff(names, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _decoded(planes: bytes) -> np.ndarray:
    rows = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T)
    return np.cumsum(rows.view("<u8").ravel(), dtype=np.uint64)


def _requests(chunk: int, kind: int, names: np.ndarray, n: int) -> list[tuple]:
    cuts = _bucket_cuts(names, n)
    return [(kind, b, chunk, _encoded(names[cuts[b] : cuts[b + 1]])) for b in range(n) if cuts[b] < cuts[b + 1]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(REQUEST)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, REQUEST.types, strict=True)], schema=REQUEST)


def _sorted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names in order, and those that occur more than once."""
    names = np.sort(names)
    same = names[1:] == names[:-1]
    return names[np.append(True, ~same)] if len(names) else names, np.unique(names[1:][same])


def _each(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The distinct names of each document, so that a name comes twice only if two documents have it."""
    if not len(names):
        return names
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    return names[np.append(True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1]))]


def _answered(names: np.ndarray, again: np.ndarray, replies: list[dict], kind: int, n: int) -> np.ndarray:
    """Status of each distinct name of a chunk: 0 alone, 1 repeated, 2 repeated and first in this chunk."""
    status = np.zeros(len(names), np.uint8)
    status[np.searchsorted(names, again)] = 2
    cuts = _bucket_cuts(names, n)
    for r in replies:
        if r["kind"] == kind:
            lo, hi = cuts[r["bucket"]], cuts[r["bucket"] + 1]
            flags = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=2 * (hi - lo)).reshape(2, -1)
            other = flags[0] == 1
            status[lo:hi][other] = 1 + flags[1][other]
    return status


def _compare(requests: DataFrame) -> DataFrame:
    """Sort the names of each bucket, compare neighbours, answer every chunk: is it also elsewhere, is this the first chunk."""

    def of(group: pa.Table) -> pa.Table:
        lists = [_decoded(x) for x in group["names"].to_pylist()]
        chunks = group["chunk"].to_pylist()
        merged = np.sort(np.concatenate(lists))
        repeated = np.unique(merged[1:][merged[1:] == merged[:-1]])
        rows: list[tuple] = []
        seen = np.zeros(len(repeated), bool)
        for i in np.argsort(chunks):
            at = np.searchsorted(repeated, lists[i])
            at[at == len(repeated)] = 0
            hit = repeated[at] == lists[i] if len(repeated) else np.zeros(len(lists[i]), bool)
            if hit.any():
                first = np.zeros(len(hit), bool)
                first[hit] = ~seen[at[hit]]
                seen[at[hit]] = True
                rows.append((chunks[i], np.packbits(np.concatenate([hit, first])).tobytes()))
        n = len(rows)
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        return pa.table(
            {
                "chunk": pa.array([r[0] for r in rows], pa.int64()),
                "kind": pa.array([kind] * n, pa.int32()),
                "bucket": pa.array([bucket] * n, pa.int32()),
                "flags": pa.array([r[1] for r in rows], pa.binary()),
            }
        )

    found = requests.groupBy("kind", "bucket").applyInArrow(of, "chunk long, kind int, bucket int, flags binary")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "flags")).alias("replies"))


REQUEST = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary())])
REQUEST_SQL = "kind int, bucket int, chunk long, names binary"


def repeated_passages(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, words: int = 0) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row; spans are byte offsets, end exclusive.

    Matches never cross documents and are judged on the input.  Null texts count as empty; texts below ``length`` bytes keep
    all; repeated rows are separate documents with equal texts, so long ones lose everything.  An empty table gives no rows.
    One document is the unit of work: a task holds one chunk or one longer document, and names of its repeated parts.

    If ``words`` is given, ``n_shared_words`` counts the words of the document that lie in a run of so many words, of any length
    in bytes, which another row has too; what is removed does not depend on it.
    """
    spark = docs.sparkSession
    chunks = store(chunks_of(docs, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    by_bytes = sampling_for(length, total)
    by_words = sampling_for(words, total // WORD_BYTES) if words else None
    n_texts = 1 + by_bytes.buckets // 64
    ids = chunks.schema["ids"].dataType.simpleString()

    def sampled(parts: list[np.ndarray], names: Names, by: Sampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the sampled suffixes of a chunk, where they start, and the document each belongs to."""
        tile = np.asarray(by.residues, np.int64)
        found, places, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for d, part in enumerate(parts):
            n = len(part)
            if n >= by.length:
                starts = (np.arange(-(-n // by.period), dtype=np.int64)[:, None] * by.period + tile).ravel()
                starts = starts[starts <= n - by.width]
                found.append(names.of(part, starts) >> by.low_bits << by.low_bits)
                places.append(starts)
                owner.append(np.full(len(starts), d, np.int32))
        return np.concatenate(found), np.concatenate(places), np.concatenate(owner)

    def texts_of(data: np.ndarray, lens: list[int]) -> list[np.ndarray]:
        at = np.cumsum([0, *lens])
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def words_of(data: np.ndarray, lens: list[int]) -> list[np.ndarray]:
        if not words:
            return [np.empty(0, np.uint64)] * len(lens)
        prints, at = Words().of(data, lens)
        return [prints[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def whole_names(data: np.ndarray, lens: list[int]) -> tuple[np.ndarray, list[str]]:
        digests, at = [], 0
        for n in lens:
            digests.append(hashlib.sha256(data[at : at + n]).digest())
            at += n
        return np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64), [d.hex() for d in digests]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, word_names = Names(by_bytes.width), by_words and Names(by_words.width)
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack(row["blob"], row["size"])
                own, _ = _sorted(sampled(texts_of(data, row["lens"]), names, by_bytes)[0])
                texts, _ = whole_names(data, row["lens"])
                texts, _ = _sorted(texts[np.asarray(row["lens"]) >= length])
                rows = _requests(row["chunk"], 0, own, by_bytes.buckets) + _requests(row["chunk"], 1, texts, n_texts)
                if words:
                    found, _, owner = sampled(words_of(data, row["lens"]), word_names, by_words)
                    rows += _requests(row["chunk"], 3, _sorted(_each(found, owner))[0], by_words.buckets)
                yield _batch(rows)

    replies = _compare(chunks.select("chunk", "lens", "size", "blob").mapInArrow(ask, REQUEST_SQL))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Settle documents without a candidate and copies; keep the others with the starts that may be repeated."""
        names, word_names = Names(by_bytes.width), by_words and Names(by_words.width)
        for batch in batches:
            kind = batch["ids"].type
            for row in batch.to_pylist():
                lens, found = row["lens"], row["replies"] or []
                data = unpack(row["blob"], row["size"])
                parts, word_parts = texts_of(data, lens), words_of(data, lens)
                own, places, owner = sampled(parts, names, by_bytes)
                distinct, again = _sorted(own)
                hit = _answered(distinct, again, found, 0, by_bytes.buckets)[np.searchsorted(distinct, own)] > 0
                mine_of = np.split(places[hit], np.searchsorted(owner[hit], np.arange(1, len(lens))))
                word_mine_of = [np.empty(0, np.int64)] * len(lens)
                if words:
                    own, places, owner = sampled(word_parts, word_names, by_words)
                    distinct, again = _sorted(_each(own, owner))
                    hit = _answered(distinct, again, found, 3, by_words.buckets)[np.searchsorted(distinct, own)] > 0
                    word_mine_of = np.split(places[hit], np.searchsorted(owner[hit], np.arange(1, len(lens))))
                texts, digests = whole_names(data, lens)
                long = np.asarray(lens) >= length
                t_distinct, t_again = _sorted(texts[long])
                t_status = _answered(t_distinct, t_again, found, 1, n_texts)
                supports: set[int] = set()
                done: list[tuple] = []
                left: list[tuple] = []
                for d, n in enumerate(lens):
                    copy = 0 if not long[d] else t_status[np.searchsorted(t_distinct, texts[d])]
                    n_words = len(word_parts[d])
                    if copy:
                        done.append((row["ids"][d], n, n, 1, _EMPTY, [0, n], n_words if n_words >= words else 0))
                        if copy == 1 or int(texts[d]) in supports:
                            continue
                        supports.add(int(texts[d]))
                    mine, word_mine = mine_of[d], word_mine_of[d]
                    if not len(mine) and not len(word_mine):
                        if not copy:
                            done.append((row["ids"][d], n, 0, 0, digests[d], [], 0))
                        continue
                    runs = _candidates(mine, n, by_bytes)
                    word_runs = _candidates(word_mine, n_words, by_words) if words else []
                    left.append((row["ids"][d], n, bool(copy), runs, word_runs, parts[d].tobytes()))
                blob, size = pack([x[5] for x in left])
                columns = [
                    pa.array([row["chunk"]], pa.int64()),
                    pa.array([[x[0] for x in left]], kind),
                    pa.array([[x[1] for x in left]], pa.list_(pa.int64())),
                    pa.array([[x[2] for x in left]], pa.list_(pa.bool_())),
                    pa.array([[x[3] for x in left]], pa.list_(pa.list_(pa.int64()))),
                    pa.array([[x[4] for x in left]], pa.list_(pa.list_(pa.int64()))),
                    pa.array([sum(int(sum(x[3][1::2]) - sum(x[3][::2])) for x in left)], pa.int64()),
                    pa.array([sum(int(sum(x[4][1::2]) - sum(x[4][::2])) for x in left)], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([blob], pa.binary()),
                    pa.array([[dict(zip(_RESULT, x)) for x in done]], pa.list_(_result_type(kind.value_type))),
                ]
                yield pa.RecordBatch.from_arrays(columns, _LEFT)

    kind = ids[len("array<") : -1]
    fields = dict(zip(_RESULT, (kind, "long", "long", "long", "string", "array<long>", "long"), strict=True))
    one = ", ".join(f"{n} {t}" for n, t in fields.items())
    done_sql = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in fields.items()) + ">>"
    lists = "copy array<boolean>, runs array<array<long>>, word_runs array<array<long>>"
    left_sql = f"chunk long, ids {ids}, lens array<long>, {lists}, n_runs long, n_word_runs long, size long, blob binary"
    joined = chunks.join(replies, "chunk", "left")
    left = store(joined.mapInArrow(narrow, f"{left_sql}, done {done_sql}"), "candidates")
    drop(chunks)  # what is still open is in ``left``
    n_open = left.agg(F.sum("n_runs"), F.sum("n_word_runs")).first()
    n_dense, n_word_dense = (max(1, -(-(n or 0) * 8 // BUCKET_BYTES)) for n in n_open)

    def dense(parts: list[np.ndarray], runs: list[list[int]], names: Names) -> tuple[np.ndarray, list[np.ndarray]]:
        places = [np.concatenate([np.empty(0, np.int64), *map(np.arange, x[::2], x[1::2])]) for x in runs]
        found = [names.of(part, starts) for part, starts in zip(parts, places, strict=True)]
        return np.concatenate([np.empty(0, np.uint64), *found]), places

    def dense_words(row: dict, data: np.ndarray, names: Names) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        own, places = dense(words_of(data, row["lens"]), row["word_runs"], names)
        return own, places, _each(own, np.repeat(np.arange(len(places)), [len(x) for x in places]))

    def ask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, word_names = Names(length), Names(words)
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack(row["blob"], row["size"])
                own, _ = _sorted(dense(texts_of(data, row["lens"]), row["runs"], names)[0])
                rows = _requests(row["chunk"], 2, own, n_dense)
                if words:
                    rows += _requests(row["chunk"], 4, _sorted(dense_words(row, data, word_names)[2])[0], n_word_dense)
                yield _batch(rows)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, word_names = Names(length), Names(words)
        for batch in batches:
            kind = batch["ids"].type.value_type
            for row in batch.to_pylist():
                data, replies = unpack(row["blob"], row["size"]), row["replies"] or []
                parts = texts_of(data, row["lens"])
                own, places = dense(parts, row["runs"], names)
                distinct, again = _sorted(own)
                hit = _answered(distinct, again, replies, 2, n_dense)[np.searchsorted(distinct, own)] > 0
                shared = [0] * len(parts)
                if words:
                    own, word_places, each = dense_words(row, data, word_names)
                    distinct, again = _sorted(each)
                    word_hit = _answered(distinct, again, replies, 4, n_word_dense)[np.searchsorted(distinct, own)] > 0
                    cuts = np.cumsum([0, *map(len, word_places)])
                    for d, starts in enumerate(word_places):
                        mine = starts[word_hit[cuts[d] : cuts[d + 1]]]
                        covered = _merged(mine, mine + words)
                        shared[d] = sum(covered[1::2]) - sum(covered[::2])
                seen, rows = 0, []
                for i, part, copy, starts, n_shared in zip(row["ids"], parts, row["copy"], places, shared, strict=True):
                    mine = starts[hit[seen : seen + len(starts)]]
                    seen += len(starts)
                    if copy:
                        continue
                    spans = _merged(mine, mine + length)
                    cuts = [0, *spans, len(part)]
                    kept = hashlib.sha256()
                    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
                        kept.update(part[a:b])
                    rows.append((i, len(part), sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2, kept.hexdigest(), spans, n_shared))
                table = [dict(zip(_RESULT, x)) for x in rows]
                yield pa.RecordBatch.from_struct_array(pa.array(table, _result_type(kind)))

    still_open = left.where("n_runs + n_word_runs > 0")
    asked = still_open.select("chunk", "lens", "runs", "word_runs", "size", "blob").mapInArrow(ask_all, REQUEST_SQL)
    open_rows = still_open.drop("done").join(_compare(asked), "chunk", "left")
    settled = left.select(F.explode("done").alias("r")).select("r.*")
    result = settled.unionByName(open_rows.mapInArrow(remove, one))
    return result if words else result.drop("n_shared_words")


_RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_shared_words")
_LEFT = ["chunk", "ids", "lens", "copy", "runs", "word_runs", "n_runs", "n_word_runs", "size", "blob", "done"]


def _result_type(kind: pa.DataType) -> pa.StructType:
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()]
    return pa.struct(list(zip(_RESULT, types, strict=True)))


def _candidates(sampled: np.ndarray, n: int, by: Sampling) -> list[int]:
    """Where strings may start that hold one of these sampled suffixes of a text of ``n`` symbols."""
    return _merged(np.maximum(sampled - (by.length - by.width), 0), np.minimum(sampled, n - by.length) + 1)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Sorted intervals, merged where they touch or overlap: start, end, start, end and so on."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return np.stack([starts[new], reach[last]], axis=1).ravel().tolist()
