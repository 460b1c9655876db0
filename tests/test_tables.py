"""Writing, reading back, and the streaming form."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_watch import frames, polls_of

from phasebeat import Settings
from phasebeat.operators import models, phases, ticks
from phasebeat.plans import datasets
from phasebeat.plans.online import visited, watch
from phasebeat.schema import TIMED_SAMPLES
from phasebeat.sources import samples as src
from phasebeat.sources import tables
from phasebeat.streaming import live
from phasebeat.workspace import new_dir


@pytest.fixture(scope="module")
def data():
    return polls_of(3, 60)


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 7) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(want) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    try:
        rows = src.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        by_file.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    assert by_file["a.txt"] == list(enumerate(want))
    assert by_file["b.txt"] == [(0, "one"), (1, ""), (2, "three")]


def test_whole_dumps(spark, tmp_path):
    (tmp_path / "d1").write_text("1 threads with trace\nStack:\nspark\n\n")
    row = src.read_dumps(spark, str(tmp_path)).first()
    assert row.path.endswith("d1") and row.value.startswith("1 threads")


def test_points_are_pruned_to_the_measurement_and_fields(spark):
    root = new_dir(spark, "points")
    df = spark.range(10).select(
        F.current_timestamp().alias("time"), F.concat(F.lit("runner-"), (F.col("id") % 2).cast("string")).alias("host"),
        F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("experiment_name"),
        F.col("id").cast("double").alias("cpu"), F.lit(1.0).alias("mem"),
    )
    tables.write_points(df, root, "usage")
    tables.write_points(df, root, "usage")
    got = tables.read_points(spark, root, "usage", host="runner-1", experiment="e0").agg(F.sum("cpu"))
    assert got.first()[0] == 24.0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "mem" not in plan.split("ReadSchema")[1] and "PartitionFilters: [isnotnull(experiment_name" in plan
    assert "EqualTo(host,runner-1)" in plan


def test_generic_points(spark):
    df = spark.createDataFrame([("h", "e", 1.0, 2.0)], "host string, experiment_name string, a double, b double")
    df = df.withColumn("time", F.current_timestamp())
    assert tables.as_generic_points(df, "m").first()["fields"] == {"a": 1.0, "b": 2.0}


def test_missing_phase_table_is_none(spark):
    assert tables.load_phases(spark, new_dir(spark, "phases"), 1, "models") is None


def test_phase_tables_come_back(spark, data):
    samples, expected = frames(spark, data)
    settings = Settings(stride=1)
    rows = visited(samples, expected, settings)[2]
    root = new_dir(spark, "phases")
    pending = models.pending_profiles(rows, settings)
    tables.save_phases(root, 2, models=models.models_by_resource(models.train(rows, settings), settings), profiles=pending)
    total = models.profiles(rows).count()
    trained = tables.load_phases(spark, root, 2, "models")
    assert tables.load_phases(spark, root, 2, "profiles").count() + 3 * trained.count() == total
    assert phases.known_phases(rows, trained).count() + phases.new_phases(rows, trained).count() == rows.count()


def test_accuracy_block(spark):
    df = spark.createDataFrame([("c", 85.12345, 92.0)], "cluster string, acc_cpu double, acc_mem double")
    lines = [r.line for r in tables.accuracy_lines(df, ["cluster"], "v1", anomaly=True).orderBy("line_no").collect()]
    assert lines == ["", "### Accuracy Rates ###", "CPU Prediction Accuracy: 85.123", "MEM Prediction Accuracy: 92.000", "Anomaly Detected"]


def timed(samples):
    ts = F.expr("timestampadd(SECOND, tick * 2, TIMESTAMP '2024-01-01 00:00:00')")
    return samples.select("cluster", "worker", ts.alias("ts"), "resource_data", "threaddump_data", "tick")


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("settings", [Settings(replay=5), Settings(stride=1, algo="simple")], ids=["replay", "simple"])
def test_stream_equals_batch(spark, data, settings, parts):
    samples, expected = frames(spark, data)
    last = samples.agg(F.max("tick")).first()[0]
    source, path, check = (new_dir(spark, n) for n in ("live", "out", "check"))
    for part in range(parts):
        low, high = last * part // parts, last * (part + 1) // parts
        arrived = timed(samples).where((F.col("tick") > low) & (F.col("tick") <= high)).drop("tick")
        arrived.orderBy(F.rand(part)).write.mode("append").json(source)
        stream = src.stream_samples(spark, source, TIMED_SAMPLES)
        ticks = live.tick_stream(stream, expected, delay="0 seconds")
        live.run_available(live.watch_stream(ticks, settings, keep_confidence=True), path, check, partitions=3)
    assert len([p for p in Path(check, "state", "0").iterdir() if p.name.isdigit()]) == 3
    got = {(r.cluster, r.tick_no): r for r in spark.read.parquet(path).collect()}
    want = {(r.cluster, r.tick_no): r for r in watch(samples, expected, settings).scored.where(f"tick < {last}").collect()}
    assert got.keys() == want.keys() and len(got) > 40
    for k, w in want.items():
        for c in ("phase_id", "idle", "seen", "version", "step", "confidence", "alert"):
            assert got[k][c] == w[c], (k, c)
        for c in ("cpu", "mem", "predicted_cpu", "predicted_mem", "acc_cpu", "acc_mem"):
            assert got[k][c] == pytest.approx(w[c], rel=1e-7, abs=1e-7), (k, c)


def test_order_of_rows_and_workers_changes_nothing(spark, data):
    samples, expected = frames(spark, data)
    settings = Settings(stride=1)

    def result(s, e):
        return sorted(map(str, watch(s, e, settings).scored.collect()))

    assert result(samples, expected) == result(samples.repartition(7, "tick"), expected.orderBy(F.desc("worker")))


def test_accuracy_is_a_percentage(spark, data):
    samples, expected = frames(spark, data)
    row = watch(samples, expected).scored.agg(F.min("acc_cpu"), F.max("acc_cpu"), F.min("acc_mem"), F.max("acc_mem")).first()
    assert all(0.0 <= v <= 100.0 for v in row)


def test_samples_of_events_are_shuffled_once(spark, tmp_path):
    """What is dealt by tick already gives the same ticks without a shuffle of texts; ids repeat or are missing."""
    rows = [(i if i % 9 else None, i % 40, ("view", "click", None)[i % 3], float(i), f'{{"k": {i % 11}}}') for i in range(300)]
    rows += rows[:60] + rows[:5]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for counts in (False, True):
        made = ticks.parse_resources(datasets.samples(spark, str(tmp_path)))
        once, twice = (ticks.gathered(made, counts, unique) for unique in (True, False))
        assert once._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1

        def plain(gathered):
            return sorted((str(r.cluster), str(r.tick), sorted(map(str, r.readings)), r.lines) for r in gathered.collect())

        assert plain(once) == plain(twice)
    assert datasets.samples(spark, str(tmp_path))._phasebeat_unique
