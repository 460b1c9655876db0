"""Mixing and sharding against what a plain computation gives, and their edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasebeat.llm.mixing import exponent_for_entropy, exponent_for_repetition, exponent_midway, mixture
from phasebeat.llm.packing import place, shards


def sources_frame(spark, tokens):
    total = sum(tokens)
    return spark.createDataFrame([(f"s{i}", t, t / total) for i, t in enumerate(tokens)], "source string, tokens long, share double")


TOKENS = [100_000, 40_000, 9_000, 9_000, 1_000]


def test_exponent_meets_the_repetition_limit(spark):
    a = exponent_for_repetition(sources_frame(spark, TOKENS), 3.0)
    assert (TOKENS[0] / TOKENS[-1]) ** (1 - a) == pytest.approx(3.0, rel=1e-5)
    assert exponent_for_repetition(sources_frame(spark, [5, 5, 5]), 2.0) == 0.0
    assert exponent_for_repetition(sources_frame(spark, TOKENS), 1.0) == pytest.approx(1.0)


def test_exponent_meets_the_entropy(spark):
    a = exponent_for_entropy(sources_frame(spark, TOKENS), 0.9)
    shares = np.array(TOKENS) / sum(TOKENS)
    weights = shares**a / (shares**a).sum()
    assert -(weights * np.log(weights)).sum() == pytest.approx(0.9 * math.log(len(TOKENS)), rel=1e-5)
    assert exponent_for_entropy(sources_frame(spark, TOKENS), 0.1) == 1.0


def corpus(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in (("hot", 900), ("b", 300), ("c", 60), (None, 40), ("=", 10)):
        rows += [(len(rows) + i, "w " * rng.randint(0, 60), source) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


@pytest.mark.parametrize("budget", [None, 12_000, 100_000])
def test_draws_fill_the_budgets(spark, budget):
    rows, docs = corpus(spark)
    drawn = mixture(docs, repetition=2.5, budget=budget, block_tokens=500).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    exponent = drawn[0].exponent
    assert (max(size.values()) / min(size.values())) ** (1 - exponent) == pytest.approx(2.5, rel=1e-4)
    power = {s: (n / sum(size.values())) ** exponent for s, n in size.items()}
    weight = {s: p / sum(power.values()) for s, p in power.items()}
    whole = budget or max(size[s] / weight[s] for s in size)
    by_source, per_epoch = defaultdict(int), Counter()
    for r in drawn:
        by_source[r.source] += r.tokens
        per_epoch[r.source, r.epoch, r.doc_id] += 1
        assert r.weight == pytest.approx(weight[r.source], rel=1e-6) or not r.tokens
        assert 0 <= r.mix_key <= 1
    for s in size:
        assert by_source[s] == pytest.approx(weight[s] * whole, abs=61)
    assert set(per_epoch.values()) == {1}
    epochs = defaultdict(set)
    for s, e, i in per_epoch:
        epochs[s, e].add(i)
    for (s, e), ids in epochs.items():  # an epoch begins after the whole of the one before
        if (s, e + 1) in epochs:
            assert ids == {i for i, _, source in rows if source == s}
    if budget is None:
        assert {r.doc_id for r in drawn} == {i for i, _, _ in rows}


def test_draws_do_not_depend_on_partitions(spark):
    _, docs = corpus(spark)
    one, other = (sorted((r.doc_id, r.epoch, r.mix_key) for r in mixture(d, block_tokens=300).collect()) for d in (docs, docs.coalesce(1)))
    assert one == other


def test_mixture_of_edges(edges, nothing):
    drawn = mixture(edges).collect()
    assert Counter(r.doc_id for r in drawn if r.epoch == 0) == Counter(r.doc_id for r in edges.collect())
    assert {r.source for r in drawn} == {None, "a", "b", "hot"}
    assert mixture(nothing).count() == 0


def packed(docs, **settings):
    rows = shards(docs, **settings).collect()
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < settings.get("n_shards", 24) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_sizes_are_near_equal_and_groups_stay_together(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abc é", k=int(rng.paretovariate(1.2) * 50) % 20_000))) for i in range(3000)]
    rows += [(4000 + i, rows[i % 9][1]) for i in range(100)] + [(5000 + i, "hot text " * 30) for i in range(1500)]
    found = packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    text = dict(rows)
    by_shard, n = defaultdict(int), Counter()
    shards_of = defaultdict(set)
    for r in found:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by_shard[r.shard] += r.size
        n[r.shard] += 1
        shards_of[text[r.doc_id]].add(r.shard)
    assert len(found) == len(rows) and len(by_shard) == 24
    assert max(by_shard.values()) - min(by_shard.values()) < 0.01 * sum(by_shard.values()) / 24
    assert max(n.values()) < 2 * min(n.values())
    assert len(shards_of["hot text " * 30]) > 1
    assert all(len(shards_of[t]) == 1 for t in shards_of if t != "hot text " * 30)


def test_placement_takes_the_highest_dot_product():
    loads = np.array([[8, 1, 1], [7, 1, 1], [1, 6, 1], [1, 5, 1], [2, 2, 2], [1, 1, 2]], float)
    found = place(loads, 2, (1.0, 1.0, 1.0), repairs=0)
    vectors, residual = loads / loads.sum(axis=0) * 2, np.ones((2, 3))
    for i in sorted(range(6), key=lambda i: (-vectors[i].sum(), i)):
        assert found[i] == int(np.argmax(residual @ vectors[i]))
        residual[found[i]] -= vectors[i]


def test_shards_of_edges(spark, edges, nothing):
    rows = packed(edges, keep=("lang", "n_chars", "shard"))
    assert len(rows) == edges.count()
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {8}
    assert packed(nothing) == []
    few = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert len(packed(few)) == 2
    assert {r.size for r in packed(few.withColumn("text", F.lit(None).cast("string")))} == {8}


def test_a_large_group_of_repeated_rows_is_spread(spark):
    """A third of all rows are one row, id and text alike."""
    rows = [(7, "same text again")] * 1000 + [(100 + i, f"text number {i}") for i in range(2000)]
    found = shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    sizes, counts = [sum(r.size for r in rs) for rs in by.values()], [len(rs) for rs in by.values()]
    assert len(found) == 3000 and len(by) == 24
    assert max(sizes) - min(sizes) <= 0.05 * max(sizes) and max(counts) <= 1.2 * min(counts)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())


def test_the_default_target_binds(spark):
    sizes = [130, 120, 110, 90, 80]
    total = sum(sizes)
    shares = np.array(sizes) / total
    docs = spark.createDataFrame([(s * 1000 + i, "w", f"s{s}") for s, n in enumerate(sizes) for i in range(n)], "doc_id long, text string, source string")
    exponent = mixture(docs).first().exponent
    weights = shares**exponent / (shares**exponent).sum()
    entropy = lambda p: -(p * np.log(p)).sum()
    assert 0 < exponent < 1
    assert entropy(weights) == pytest.approx((entropy(shares) + math.log(5)) / 2, rel=1e-6)
    # Where the entropy would repeat a source over twice, the repetition limit holds.
    a = exponent_midway(sources_frame(spark, TOKENS))
    assert (TOKENS[0] / TOKENS[-1]) ** (1 - a) == pytest.approx(2.0, rel=1e-5)
    assert exponent_midway(sources_frame(spark, [5])) == pytest.approx(1.0)
