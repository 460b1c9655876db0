"""Streams under load: many frames a trigger, rows that come too late, clusters that end on their own."""

import random
from itertools import islice

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_tables import timed
from test_watch import frames, polls_of

from phasebeat import Settings
from phasebeat.plans.online import watch
from phasebeat.schema import TIMED_SAMPLES
from phasebeat.sources import samples as src
from phasebeat.streaming import live
from phasebeat.streaming.order import Runs, in_parts
from phasebeat.workspace import new_dir


class Map:
    """A map state that counts what it gives out and holds."""

    def __init__(self):
        self.rows, self.most = {}, 0

    def updateValue(self, key, value):
        self.rows[key] = value
        self.most = max(self.most, len(self.rows))

    def getValue(self, key):
        return self.rows[key]

    def removeKey(self, key):
        del self.rows[key]


def batches(rng, n_frames, rows, values):
    for f in range(n_frames):
        yield pd.DataFrame({"at": [rng.randrange(values) for _ in range(rows)], "frame": f, "place": range(rows)})


@pytest.mark.parametrize("n_frames, rows, fan_in", [(0, 0, 2), (1, 50, 2), (2, 1, 2), (7, 13, 3), (40, 9, 3), (40, 300, 32)])
def test_runs_give_rows_in_order(n_frames, rows, fan_in):
    made = pd.concat([pd.DataFrame({"at": [], "frame": [], "place": []}), *batches(random.Random(1), n_frames, rows, 40)])
    state = Map()
    found = list(Runs(state, "at", 16, fan_in).of(batches(random.Random(1), n_frames, rows, 40)))
    assert [tuple(r) for r in found] == [tuple(r) for r in made.sort_values(["at", "frame", "place"]).itertuples(index=False)]
    assert not state.rows and bool(state.most) == (n_frames > 1)


def test_what_is_held_does_not_grow_with_the_frames(monkeypatch):
    """Blocks that are open at once: one per run that is merged, however many frames there are."""
    for n_frames in (10, 200):
        open_blocks, most = [0], [0]
        take = Runs._take

        def counted(self, run, row):
            for i, x in enumerate(take(self, run, row)):
                open_blocks[0] += i == 0
                most[0] = max(most[0], open_blocks[0])
                yield x
            open_blocks[0] -= 1

        monkeypatch.setattr(Runs, "_take", counted)
        assert sum(1 for _ in Runs(Map(), "at", 8, 4).of(batches(random.Random(2), n_frames, 20, 1000))) == 20 * n_frames
        monkeypatch.setattr(Runs, "_take", take)
        assert most[0] <= 4 * 5  # at most fan_in runs in each of the passes that are under way


def test_parts():
    assert [len(p) for p in in_parts(islice(zip(range(100)), 25), ["a"], 10)] == [10, 10, 5]
    assert list(in_parts(iter([]), ["a"])) == []


@pytest.fixture(scope="module")
def data():
    return polls_of(8, 80)


def streamed(spark, samples, expected, settings, path=None, check=None, **options):
    source = new_dir(spark, "live")
    timed(samples).drop("tick").orderBy(F.rand(3)).write.json(source)
    path, check = path or new_dir(spark, "out"), check or new_dir(spark, "check")
    arrived = live.tick_stream(src.stream_samples(spark, source, TIMED_SAMPLES), expected, delay="0 seconds")
    live.run_available(live.watch_stream(arrived, settings, **options), path, check, partitions=2)
    return spark.read.parquet(path)


def facts(rows):
    return sorted((r.cluster, r.tick_no, r.phase_id, r.version, r.confidence, r.alert, round(r.acc_cpu, 6)) for r in rows)


def test_many_frames_a_trigger(spark, data):
    samples, expected = frames(spark, data)
    settings = Settings(stride=1, replay=0)
    names = [n for n in ("spark.sql.execution.arrow.maxRecordsPerBatch",) if spark.conf.get(n)]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "5")
    try:
        few = facts(streamed(spark, samples, expected, settings).collect())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    last = samples.agg(F.max("tick")).first()[0]
    assert few == facts(watch(samples, expected, settings).scored.where(f"tick < {last}").collect()) and len(few) > 100


def test_a_cluster_ends_at_its_alert_and_others_go_on(spark, data):
    samples, expected = frames(spark, data)
    settings = Settings(stride=1, replay=0, confidence_limit=1, mape_limit=1.0)
    last = samples.agg(F.max("tick")).first()[0]
    whole = watch(samples, expected, settings).scored.where(f"tick < {last}").collect()
    until = watch(samples, expected, settings, stop_at_first=True).scored.where(f"tick < {last}").collect()
    found = streamed(spark, samples, expected, settings, stop_on_alert=True).collect()
    assert facts(found) == facts(until)
    assert len(found) < len(whole) and len({r.cluster for r in found if r.alert}) == sum(r.alert for r in found) > 0


def late_backlog(spark, tmp_path):
    """Three files, the last of which has samples of an hour before the first.

    The watermark that lateness is judged by is that of the batch before, so a single batch of delay is no harm.
    """
    rows = [("c", "w", f"2024-01-01 {h:02}:00:{s:02}", "1,1", ["f"]) for h in (2, 3, 1) for s in range(0, 20, 2)]
    for i, part in enumerate((rows[:10], rows[10:20], rows[20:])):
        df = spark.createDataFrame(part, "cluster string, worker string, ts string, resource_data string, threaddump_data array<string>")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    (tmp_path / "workers.csv").write_text("c,w\n")
    samples = src.stream_samples(spark, str(tmp_path / "in"), TIMED_SAMPLES, maxFilesPerTrigger="1")
    expected = spark.createDataFrame([("c", "w")], "cluster string, worker string")
    return live.watch_stream(live.tick_stream(samples, expected, delay="0 seconds"), Settings(stride=1, algo="simple"))


def test_late_rows_are_a_failure_with_their_number(spark, tmp_path):
    stream = late_backlog(spark, tmp_path)
    with pytest.raises(live.LateRows, match="10 rows") as error:
        live.publish(stream, str(tmp_path / "p"), str(tmp_path / "check"), "h", "e", partitions=1)
    assert error.value.count == 10


def test_late_rows_can_be_counted(spark, tmp_path):
    stream = late_backlog(spark, tmp_path)
    assert live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"), partitions=1, late="count").late == 10
    # The intervals of two files but the last, which is open.
    assert spark.read.parquet(str(tmp_path / "out")).count() == 19
    with pytest.raises(ValueError, match="late rows"):
        live.run_available(stream, str(tmp_path / "out2"), str(tmp_path / "check2"), late="drop")


def test_closed_intervals_are_not_broadcast(spark):
    """The batch of an end marker has one row of input, but all closed intervals come from the state."""
    source, check = new_dir(spark, "live"), new_dir(spark, "check")
    rows = spark.range(40).selectExpr(
        "concat('c', id % 2) AS cluster", "'w0' AS worker", "timestamp_seconds(id) AS ts", "'1,2' AS resource_data", "array('f') AS threaddump_data"
    )
    workers = rows.select("cluster", "worker").distinct()
    found, plans = [], []
    for part in (rows, live.end_marker(rows, "ts", "10 seconds")):
        part.write.mode("append").json(source)
        stream = live.tick_stream(src.stream_samples(spark, source, TIMED_SAMPLES), workers, "1 second", "0 seconds")
        with live.state_store(spark, 2):
            query = (
                stream.writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect()))
                .option("checkpointLocation", check).trigger(availableNow=True).start()
            )
        query.awaitTermination()
        plans.append(query._jsq.explainInternal(False))
    assert sorted(r.tick.timestamp() for r in found) == list(range(40))
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_functions_are_not_dealt_as_rows(spark):
    """A sample stays one row up to its tick, and texts reach the state once sorted: equal sets are equal texts."""
    rows = [("c", w, t, line, fs) for t in (0, 1) for w, line, fs in (
        ("w1", "1,2", [" b *** 1\n", " a *** 2\n", "a *** 3"]), ("w2", "x,2", [None, "c"]), (None, "5,5", ["d"]), ("w9", "7,8", None)
    )]
    samples = spark.createDataFrame(rows, "cluster string, worker string, s int, resource_data string, threaddump_data array<string>")
    samples = samples.selectExpr("cluster", "worker", "timestamp_seconds(s) AS ts", "resource_data", "threaddump_data")
    workers = spark.createDataFrame([("c", "w2"), ("c", "w1"), ("c", "w3")], "cluster string, worker string")
    ticks = live.tick_stream(samples, workers, "1 second", "0 seconds")
    assert "Generate" not in ticks._jdf.queryExecution().optimizedPlan().toString()
    found = ticks.collect()
    assert len(found) == 2
    for tick in found:
        assert (tick.said, tick.workers, tick.functions) == ('[null,"w1","w2","w9"]', '["w1","w2","w3"]', '["a ","b ","c","d"]')
        assert (tick.cpus, tick.mems) == ([5.0, 1.0, None, 7.0], [5.0, 2.0, 2.0, 8.0])


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class States:
    """The states of a processor, held in plain dictionaries."""

    def __init__(self):
        self.value, self.maps = Value(), {}

    def getValueState(self, name, schema):
        return self.value

    def getMapState(self, name, key, value):
        state = self.maps[name] = Map()
        state.containsKey = state.rows.__contains__
        return state


def test_a_text_is_taken_apart_once(monkeypatch):
    """The work on the ticks of a hot cluster does not grow with its functions where sets come back."""
    parsed = []
    loads = live.json.loads
    monkeypatch.setattr(live.json, "loads", lambda text: parsed.append(text) or loads(text))
    texts = [f'["f{i}","g"]' for i in range(3)]
    frame = pd.DataFrame({
        "cluster": "c", "tick": pd.date_range("2024-01-01", periods=60, freq="s")[::-1], "said": ['["a"]', '["a","b","x"]'] * 30,
        "cpus": [np.array([float("nan")]), np.array([4.0, 6.0, 100.0])] * 30, "mems": [np.array([3.0]), np.array([1.0, 2.0, 100.0])] * 30,
        "functions": texts * 20, "workers": '["a","b"]',
    })
    states = States()
    watcher = live.ClusterWatcher(Settings(stride=1, algo="simple"))
    watcher.init(states)
    found = pd.concat(watcher.handleInputRows(("c",), iter([frame]), None))
    assert sorted(parsed) == sorted([*texts, '["a"]', '["a","b","x"]', '["a","b"]'])
    assert list(found.tick) == list(frame.tick[::-1])
    # A silent worker adds nothing, a malformed reading repeats the one before, a stranger is not counted.
    assert found[["cpu", "mem"]].values.tolist() == [[5.0, 1.5], [2.0, 1.5]] * 30
    assert states.maps["last"].rows == {("a",): (4.0, 3.0), ("b",): (0.0, 0.0)}


@pytest.mark.parametrize("empty", [False, True])
def test_an_empty_function_joins_the_sets_of_ticks_with_a_silent_worker(monkeypatch, empty):
    """Sets with and without it are told apart, and neither is taken apart again."""
    parsed = []
    loads = live.json.loads
    monkeypatch.setattr(live.json, "loads", lambda text: parsed.append(text) or loads(text))
    frame = pd.DataFrame({
        "cluster": "c", "tick": pd.date_range("2024-01-01", periods=40, freq="s"), "said": ['["a"]', '["a"]', '["a","b"]', '["a","b"]'] * 10,
        "cpus": [np.ones(1), np.ones(1), np.ones(2), np.ones(2)] * 10, "mems": [np.ones(1), np.ones(1), np.ones(2), np.ones(2)] * 10,
        "functions": '["f","g"]', "workers": '["a","b"]',
    })
    watcher = live.ClusterWatcher(Settings(stride=1, algo="simple"), empty_function=empty)
    watcher.init(States())
    found = pd.concat(watcher.handleInputRows(("c",), iter([frame]), None))
    plain, both = (live.hashlib.md5("".join(f + live.ARROW for f in names).encode()).hexdigest() for names in (["f", "g"], ["", "f", "g"]))
    # Of two neighbouring sets the common functions are the phase; the first tick has no set before it.
    assert found.phase_id.tolist()[1:] == [both if empty and i % 4 == 1 else plain for i in range(1, 40)]
    assert sorted(parsed) == sorted(['["f","g"]', '["a"]', '["a","b"]'])
