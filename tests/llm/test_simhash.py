"""SimHash against all pairs, and the covering property of the masks."""

import random
import re

import numpy as np
import pytest
import xxhash

from phasebeat.llm import simhash
from phasebeat.llm.components import components
from phasebeat.llm.simhash import fingerprint, links, masks, near_duplicates, tree
from phasebeat.workspace import store
from tests_llm_help import classes


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] if len(found) > 3 else [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_some_mask_covers_every_difference_within_the_radius():
    rng = random.Random(1)
    found = [m & (2**64 - 1) for m in masks()]
    assert len(found) == 31
    for _ in range(20_000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & difference == 0 for m in found)


@pytest.mark.parametrize("text", [None, "", "  ", "One", "one TWO three", "a b c d", "a b c d e É é " * 40])
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == plain_fingerprint(text)


def clustered(rng, n):
    """Values of which many are near each other, in chains and balls."""
    values = []
    while len(values) < n:
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << b
            values.append(v)
    return [v - 2**64 if v >> 63 else v for v in set(values)]


def all_pairs(values, radius=4):
    v = np.array(values, np.int64).view(np.uint64)
    pairs = [(i, j) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= radius) + i + 1]
    return classes(range(len(v)), pairs)


def test_rows_dealt_to_tables_are_never_broadcast(spark, monkeypatch):
    """A written table of classes is small, its rows in all tables are not."""
    plans = {}

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(simhash, "store", noted)
    written = store(spark.createDataFrame([(v,) for v in clustered(random.Random(3), 50)], "fp long"), "classes")
    links(written)
    assert "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]


@pytest.mark.parametrize("bucket", [4096, 6])
def test_links_join_what_all_pairs_would(spark, bucket):
    """A small bucket size takes the further families and the tiles."""
    values = clustered(random.Random(bucket), 400)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {(r.u, r.v) for r in links(df, bucket=bucket).collect()}
    at = {v: i for i, v in enumerate(values)}
    assert classes(range(len(values)), [(at[u], at[v]) for u, v in found]) == all_pairs(values)


def test_tree_of_two_sides_keeps_what_pairs_across_join():
    values = np.array(clustered(random.Random(3), 200), np.int64).view(np.uint64)
    left = np.arange(len(values)) % 2 == 0
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if left[i] != left[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 4]
    assert classes(range(len(values)), tree(values, 4, left)) == classes(range(len(values)), pairs)


def test_components_of_a_chain_a_hub_and_pairs(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5001), (5001, 5000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)} | {5000: 5000, 5001: 5000}


def test_edges(edges):
    rows = near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    fps = {r.doc_id: r.fingerprint for r in rows}
    assert fps[1] == fps[2] == fps[3] == "0" * 16
    component = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert component[1, "0" * 16] == component[3, "0" * 16] == 1
    assert {r.component_id for r in rows if r.doc_id in (4, None)} == {4}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in rows if r.doc_id == 100 or (r.doc_id or 0) >= 200} == {100}
    assert len({(r.doc_id, r.mark) for r in rows if r.kept}) == len({r.component_id for r in rows})


def test_nothing(nothing):
    assert near_duplicates(nothing).count() == 0
    assert simhash.near_duplicates(nothing).columns[:3] == ["doc_id", "fingerprint", "component_id"]
