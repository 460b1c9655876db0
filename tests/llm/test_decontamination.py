"""Decontamination against plain windows."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from phasebeat.llm.decontamination import SuffixArray, contamination, longest_common, matches
from phasebeat.llm.wordnames import WordNames

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for x in [w[k : k + 10] for k in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []:
            windows.setdefault(tuple(x), set()).update([str(i)] if i is not None else [])
    out = []
    for i, t in docs:
        w, found = split(t), set()
        hit = bytearray(len(w))
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit[k : k + n] = b"\1" * n
                    found |= windows[x]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), sum(hit), len(found), digest, sum(hit) > 0))
    return sorted(out, key=str)


def found(spark, docs, items, **settings):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(docs, items, **settings).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 400, "item_block_bytes": 300}])
def test_random(spark, settings):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choices(["ab", "Cd", "é1", "ef-gh", "x", "中文"], k=n))
    items = [(i, some(rng.choice([0, 3, 9, 10, 11, 40]))) for i in range(25)] + [(7, some(12)), (None, some(15)), (50, None)]
    docs = [(i, some(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "")[: rng.randint(0, 200)] if rng.random() < 0.7 else some(30)) for i in range(26)]
    docs += [(9, docs[9][1]), (None, items[3][1]), (60, None), (61, "")]
    assert found(spark, docs, items, **settings) == expected(docs, items)


def test_long_word_and_long_text(spark):
    rng = random.Random(4)
    many = " ".join(str(rng.randint(0, 10**9)) for _ in range(60_000))
    word = "y" * 300_000
    items = [(1, many[100_000:101_000]), (2, f"{word} a b"), (3, many[:50])]
    docs = [(1, many), (2, f"b {word} a b c"), (3, "z" * 200_000)]
    assert found(spark, docs, items) == expected(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")]) == []
    assert found(spark, [(1, "a b c")], []) == expected([(1, "a b c")], [])


def test_longest_match_has_its_place(spark):
    text = " ".join(f"w{i}" for i in range(100))
    names = WordNames()
    of = lambda t: names.of(np.frombuffer(t.encode(), np.uint8))[0]
    array = SuffixArray(of(text))
    item = "u v " + " ".join(f"w{i}" for i in range(30, 55)) + " v"
    got = [tuple(int(x[0]) for x in m) for m in matches(array, [of(item)])]
    assert got == [(0, 30, 2, 25)]


def test_edges(spark, edges):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = contamination(edges, items).collect()
    assert len(rows) == edges.count()
    assert sorted((r.doc_id or 0) for r in rows if r.contaminated) == [0, 4, 4]


@pytest.mark.parametrize("n", range(11))
def test_tiny_chunk_of_one_document(n):
    names = WordNames()
    of = lambda t: names.of(np.frombuffer(t.encode(), np.uint8))[0]
    text = " ".join(f"w{i}" for i in range(n))
    array = SuffixArray(np.append(of(text), np.uint64(0)))
    got = [tuple(int(x) for x in row) for m in matches(array, [of(text), of("u v w")]) for row in zip(*m, strict=True)]
    assert got == ([(0, 0, 0, n)] if n else [])


@pytest.mark.parametrize("texts", [[" ".join("abcdefghij"[:n])] for n in range(1, 11)] + [[""] * n for n in range(1, 9)])
def test_tiny_tables(spark, texts):
    items = [(1, "a b c"), (2, "a b c d e f g h i j")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(tuple(r) for r in rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == expected(list(enumerate(texts)), items)


def test_repeated_words_cost_no_pairs():
    names = WordNames()
    of = lambda t: names.of(np.frombuffer(t.encode(), np.uint8))[0]
    array = SuffixArray(np.append(of("0 " * 400_000 + "a b"), np.uint64(0)))
    tracemalloc.start()
    longest = np.zeros(400_002, np.int64)
    for _, place, _, words in matches(array, [of("0 " * 1_000), of("x " + "0 " * 30 + "a")]):
        np.maximum.at(longest, place, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(longest[:399_001].tolist()) == {1_000}
    assert longest[399_970] == 31 and longest[399_990] == 0  # the rest of a match is not one of its own
    assert peak < 200_000_000


@pytest.mark.parametrize("seed", range(6))
def test_longest_common_runs(seed):
    rng = np.random.default_rng(seed)
    text, query = (np.append(rng.integers(0, 3, n), 0) for n in (200, 80))
    length, at = longest_common(text, query)

    def run(a, b):
        n = 0
        while text[a + n] and text[a + n] == query[b + n]:
            n += 1
        return n

    for a in range(len(text)):
        assert length[a] == max(run(a, b) for b in range(len(query)))
        assert run(a, at[a]) == length[a]


def test_many_items_in_one_document(spark):
    rng = random.Random(6)
    same = " ".join(f"s{i}" for i in range(12))
    items = [(i, f"{same} {rng.randint(0, 99)} " + " ".join(rng.choices("ab", k=rng.randint(0, 15)))) for i in range(300)]
    docs = [(i, " ".join(rng.choices("ab", k=60)) + " " + (same if i % 2 else "") + " a" * 25) for i in range(20)]
    assert found(spark, docs, items) == expected(docs, items)
    assert found(spark, docs, items, item_block_bytes=2_000) == expected(docs, items)


def test_memory_of_a_suffix_array():
    """The peak while an array is built, in bytes a word, and what it keeps."""
    names = np.random.default_rng(1).integers(1, 2**60, 1 << 18).astype(np.uint64)
    tracemalloc.start()
    array = SuffixArray(names)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert array.words.dtype == np.int32
    assert kept <= 53 * len(names) and peak <= 96 * len(names)
