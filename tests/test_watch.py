"""The window-function form against a plain loop, on random sample streams."""

import math
import random

import pytest
from sequential import evaluate

from phasebeat import Settings
from phasebeat.operators import replay, ticks
from phasebeat.plans.online import watch
from phasebeat.schema import SAMPLES
from phasebeat.workspace import store

CLUSTERS = {"a": ["a1", "a2", "a3"], "b": ["b1", "b2"], "c": ["c1"]}
LINES = ["{c},{m}", "{c},{m}", "{c},{m}", "{c},{m}", " {c} , {m}", "{c},", "{c},x", "{c},{m},1", "", "0,0"]


def polls_of(seed, ticks):
    rng = random.Random(seed)
    data = {}
    for cluster, workers in CLUSTERS.items():
        tick, data[cluster] = 0, []
        for _ in range(ticks):
            tick += rng.choice([1, 1, 1, 2, 5])
            idle = rng.random() < 0.15
            base = rng.choice([["f", "g", "h", "i"], ["f", "g", "h"], ["x", "y"], ["f"]])
            said = {}
            for w in workers:
                if rng.random() < 0.1 and len(said) + 1 < len(workers):
                    continue
                line = rng.choice(LINES).format(c=rng.randint(0, 900) / 10, m=rng.randint(0, 400) / 10)
                funcs = [] if idle else [f"  {f} *** {rng.randint(1, 2)}\n" for f in base if rng.random() < 0.9]
                said[w] = (line, funcs)
            if not said:
                said[workers[0]] = ("1,1", [])
            data[cluster].append((tick, said))
    return data


def frames(spark, data):
    rows = [
        (c, w, tick, line, funcs) for c, polls in data.items() for tick, said in polls for w, (line, funcs) in said.items()
    ]
    random.Random(1).shuffle(rows)
    expected = [(c, w) for c, ws in CLUSTERS.items() for w in ws]
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(expected, "cluster string, worker string")


def check(data, settings, result, loops=None):
    names = {r.phase_id: r.phase for r in result.phases.collect()}
    got = {(r.cluster, r.tick): r for r in result.scored.collect()}
    total = 0
    for cluster, polls in data.items():
        for want in evaluate(polls, CLUSTERS[cluster], settings, loops, cluster):
            row = got[(cluster, want["tick"])]
            total += 1
            assert names[row.phase_id] == want["phase"]
            for c in ("seen", "step", "confidence"):
                assert row[c] == want[c], (cluster, want, row)
            for c in ("cpu", "mem", "predicted_cpu", "predicted_mem", "mape", "acc_cpu", "acc_mem"):
                if want[c] is None:
                    assert math.isnan(row[c])
                else:
                    assert row[c] == pytest.approx(want[c], rel=1e-7, abs=1e-7), (c, want, row)
    assert total == len(got)


CASES = [
    Settings(algo="simple"),
    Settings(stride=1, replay=0),
    Settings(),
    Settings(stride=1, seed=3),
    Settings(variant="v1", algo="agg", stride=1),
    Settings(variant="v1", algo="lasso"),
    Settings(variant="v1", algo="agg"),
]


@pytest.mark.parametrize("settings", CASES, ids=lambda s: f"{s.variant}-{s.algo}-{s.stride}-{s.replay}")
@pytest.mark.parametrize("segment_rows", [1 << 18, 16])
def test_windows_agree_with_loop(spark, settings, segment_rows):
    data = polls_of(7, 120)
    samples, expected = frames(spark, data)
    settings = Settings(**{**settings.__dict__, "segment_rows": segment_rows})
    check(data, settings, watch(samples, expected, settings))


def test_first_alert_ends_the_run(spark):
    data = polls_of(11, 80)
    samples, expected = frames(spark, data)
    for rows in (1 << 18, 16):
        settings = Settings(stride=1, confidence_limit=2, segment_rows=rows)
        full = watch(samples, expected, settings).scored.collect()
        cut = watch(samples, expected, settings, stop_at_first=True).scored.collect()
        for cluster in CLUSTERS:
            fired = [r.tick_no for r in full if r.cluster == cluster and r.alert]
            last = min(fired) if fired else math.inf
            want = sorted(r.tick_no for r in full if r.cluster == cluster and r.tick_no <= last)
            assert sorted(r.tick_no for r in cut if r.cluster == cluster) == want


def test_long_replay_chains_agree_with_short_ones(spark):
    data = polls_of(5, 150)
    samples, expected = frames(spark, data)
    settings = Settings(stride=1, replay=5)
    from phasebeat.operators.models import batches
    from phasebeat.plans.online import visited

    full = batches(visited(samples, expected, settings)[2], settings)
    whole = replay.replayed_lasso(full, settings).collect()
    pieces = replay.replayed_lasso(full, settings, chain_rows=3).collect()
    key = lambda r: (r.cluster, r.phase_id, r.version)
    assert max(r.version for r in whole) > 6
    for a, b in zip(sorted(whole, key=key), sorted(pieces, key=key), strict=True):
        assert key(a) == key(b)
        assert list(a)[3:] == pytest.approx(list(b)[3:], rel=1e-12, abs=1e-12)


RESUMED = [
    Settings(stride=1), Settings(replay=0), Settings(algo="simple"),
    Settings(variant="v1", algo="agg", stride=1), Settings(variant="v1"),
]


@pytest.mark.parametrize("settings", RESUMED, ids=lambda s: f"{s.variant}-{s.algo}-{s.stride}-{s.replay}")
def test_stopped_runs_go_on(spark, settings):
    """Three runs, each from what the one before saved; confidence and fill values start anew."""
    from phasebeat.plans.online import Saved
    from phasebeat.workspace import new_dir

    data, root, before, loops = polls_of(13, 120), new_dir(spark, "phases"), None, {}
    for part, (low, high) in enumerate([(0, 41), (41, 80), (80, 120)]):
        piece = {c: polls[low:high] for c, polls in data.items()}
        samples, expected = frames(spark, piece)
        result = watch(samples, expected, settings, before=before)
        check(piece, settings, result, loops)
        result.state().save(root, part)
        before = Saved.load(spark, root, part)
    assert Saved.load(spark, root, 99) is None


def test_parts_of_a_dictionary_are_never_broadcast(spark, monkeypatch):
    """Spark would size the sixteen parts of each row as one; only rows that were counted to be few are sent as they are."""
    rows = spark.createDataFrame([(t, f"s{t % 3}", f"s{t % 2}") for t in range(40)], "tick long, set_id_prev1 string, set_id string")
    small = store(spark.createDataFrame([(f"s{a}", f"s{b}", a * b) for a in range(3) for b in range(2)], "set_id_prev1 string, set_id string, n int"), "pairs")
    expected = sorted((t, f"s{t % 3}", f"s{t % 2}", (t % 3) * (t % 2)) for t in range(40))
    for few, join in ((ticks.SENT_ROWS, "BroadcastHashJoin"), (5, "SortMergeJoin")):
        monkeypatch.setattr(ticks, "SENT_ROWS", few)
        found = ticks.join_written(rows, small, ticks.SET_IDS, "tick").select("tick", *ticks.SET_IDS, "n")
        assert sorted(tuple(r) for r in found.collect()) == expected
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert join in plan and plan.count("Join") == 1
