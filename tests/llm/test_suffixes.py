"""Repeated passages against a count of every string, and the edge cases of the table."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phasebeat.llm.suffixes import cover_for, difference_cover, repeated_passages


@pytest.mark.parametrize("power", [1, 2, 3, 4])
def test_cover_has_every_difference(power):
    period, residues = difference_cover(power)
    assert {(a - b) % period for a in residues for b in residues} == set(range(period))


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
        out.append((i, len(b), sum(gone), spans, kept))
    return sorted(out, key=str)


def found(spark, rows, length, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({"chunk": F.lit("x"), "blob": F.lit(1), "lens": F.lit(None).cast("int")})
    result = repeated_passages(docs, length, **settings).drop("spans").collect()
    return sorted((tuple(r) for r in result), key=str)


@pytest.mark.parametrize(("length", "seed"), [(5, 1), (30, 2), (110, 3), (400, 4)])
def test_random_texts(spark, length, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("ab é", k=rng.randint(length - 2, 3 * length))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choices("abcdefgh", k=rng.randint(0, 2 * length)))]) for _ in range(4)]
        rows.append((i, "".join(parts)[rng.randint(0, length) :]))
    assert found(spark, rows, length, chunk_bytes=5 * length) == expected(rows, length)


def test_edges(spark):
    long = "x" * 1000 + "".join(random.Random(1).choices("abcdefghijklmnop", k=300_000))
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "a" * 50), (5, long), (6, long), (6, long), (7, long[70_000:140_000]), (8, "ab" * 300)]
    assert found(spark, rows, 40) == expected(rows, 40)


def test_empty(spark):
    assert found(spark, [], 40) == []


def expected_words(rows, words):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    windows = [[tuple(t[k : k + words]) for k in range(len(t) - words + 1)] for t in texts]
    having = Counter(w for each in windows for w in set(each))
    covered = [{k + j for k, w in enumerate(each) if having[w] > 1 for j in range(words)} for each in windows]
    return sorted(((i, len(c)) for (i, _), c in zip(rows, covered)), key=str)


def shared_words(spark, rows, length, words, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    result = repeated_passages(docs, length, words=words, **settings)
    return sorted((tuple(r) for r in result.select("doc_id", "n_shared_words").collect()), key=str), result


def test_short_passages_in_two_documents(spark):
    rng = random.Random(8)
    some = lambda n: [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k)) for k in [n] * 4]
    passage, almost, own, _ = (" ".join(x.split()[:n]) for x, n in zip(some(60), [55, 50, 60, 0]))
    rows = [(i, f"{t} {middle} {t[::-1]}") for i, (t, middle) in enumerate(zip(some(90), [passage, passage, almost, f"{almost} {own} {own}"]))]
    assert len(passage) < 400
    found, result = shared_words(spark, rows, 400, 51)
    assert found == [(0, 55), (1, 55), (2, 0), (3, 0)]
    assert result.where("n_removed > 0").count() == 0


@pytest.mark.parametrize(("words", "seed"), [(1, 1), (5, 2), (11, 3), (51, 4)])
def test_shared_words(spark, words, seed):
    rng = random.Random(seed)
    some = lambda n: "".join("".join(rng.choices("abé", k=rng.randint(1, 5))) + rng.choice([" ", "\n", "\t ", "\x0b", "  "]) for _ in range(n))
    passages = [some(rng.randint(max(1, words - 2), 3 * words)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(passages), some(2 * words)]) for _ in range(4))) for i in range(40)]
    rows += [(i % 3 or None, t) for i, t in rows[:5]] + [(50, None), (51, " \n "), (52, "the " * 3 * words), (53, "the\n" * 2 * words)]
    assert shared_words(spark, rows, 100, words, chunk_bytes=600 * words)[0] == expected_words(rows, words)


def test_shared_long_words(spark):
    long, other = ("".join(random.Random(k).choices("abcdefgh", k=200_000)) for k in (1, 2))
    rows = [(1, f"a {long} b c" + " " * 150_000 + "d"), (2, f"a {long} b c d e"), (3, f"a {other} b c d"), (4, f"x a {long}{other} b c d")]
    assert shared_words(spark, rows, 400, 4)[0] == expected_words(rows, 4) == [(1, 5), (2, 5), (3, 0), (4, 0)]


def test_shared_words_leave_the_rest_as_it_is(spark, edges, nothing):
    plain, more = repeated_passages(edges), repeated_passages(edges, words=51)
    key = lambda r: str(tuple(r)[:6])
    assert sorted(map(key, plain.collect())) == sorted(map(key, more.collect()))
    assert more.columns == [*plain.columns, "n_shared_words"]
    assert repeated_passages(nothing, words=51).collect() == []
