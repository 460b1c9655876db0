"""Worked cases, one per operator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasebeat import Settings
from phasebeat.functions import errors, text
from phasebeat.functions import phases as ph
from phasebeat.functions.lasso import fit_many, fit_points, with_lasso
from phasebeat.operators import anomaly, compare, dumps, models, ordered, phases, replay, reports, runs, ticks, traffic
from phasebeat.operators.ordered import scan
from phasebeat.schema import SAMPLES
from phasebeat.workspace import store


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


WORKERS = [("c", "w1"), ("c", "w2"), ("c", "w3")]


def polls(spark, rows):
    expected = spark.createDataFrame(WORKERS, "cluster string, worker string")
    data = [("c", f"w{i + 1}", t, line, []) for t, lines in rows.items() for i, line in enumerate(lines) if line is not None]
    return spark.createDataFrame(data, SAMPLES), expected


@pytest.mark.parametrize("cut", [None, 2])
def test_malformed_fields_are_filled_forward(spark, cut):
    samples, expected = polls(spark, {1: ["30,10", "60,20", "90,30"], 2: ["30,", "60,abc", ""], 3: ["33,5,9", "x,26", "90,30"]})
    got = ticks.cluster_means(ticks.fill_forward(ticks.parse_resources(samples), cut), expected)
    assert sorted(map(tuple, got.collect())) == [("c", 1, 60.0, 20.0), ("c", 2, 60.0, 20.0), ("c", 3, 60.0, 22.0)]


def test_first_malformed_value_is_zero_and_divisor_is_fixed(spark):
    samples, expected = polls(spark, {1: ["cpu,", "3,6", None]})
    got = ticks.cluster_means(ticks.fill_forward(ticks.parse_resources(samples)), expected)
    assert list(map(tuple, got.collect())) == [("c", 1, 1.0, 2.0)]


def test_silent_worker_counts_as_zero_from_then_on(spark):
    samples, expected = polls(spark, {1: ["30,10", "60,20", "90,30"], 2: [None, "60,20", "90,30"], 3: ["x,y", "60,20", "90,30"]})
    assert list(map(tuple, ticks.missing_workers(samples, expected).collect())) == [("c", 2, "w1")]
    got = {r.tick: r for r in ticks.cluster_ticks(samples, expected).collect()}
    assert (got[3].cpu, got[3].mem) == (50.0, 50.0 / 3)
    assert got[2].funcs == []
    with_empty = {r.tick: r for r in ticks.cluster_ticks(samples, expected, empty_function=True).collect()}
    assert with_empty[2].funcs == [""]


def test_numbers(spark):
    given = ["1", " 2.5 ", "1_0", "1e3", "-.5", "+4.", "1.5d", "0x10", "1__0", "_1", "", "nan", "inf", "abc"]
    want = [1.0, 2.5, 10.0, 1000.0, -0.5, 4.0] + [None] * 8
    assert column(spark, given, text.to_number) == want
    loose = column(spark, ["nan", "-inf", "x"], lambda c: text.to_number(c, accept_non_finite=True))
    assert math.isnan(loose[0]) and loose[1] == -math.inf and loose[2] is None


DUMP = """3 threads with trace
Stack:
at org.apache.spark.A <0x00ff>
at B

2 threads with trace
Stack:
at C

1 threads with trace
Stack:
at org.apache.spark.D
"""


def test_dump(spark):
    stacks = column(spark, [DUMP], lambda c: text.dump_stacks(text.scrub_addresses(c)))[0]
    assert [(s.stack, s.threads) for s in stacks] == [("Stack:at org.apache.spark.A at B", "3"), ("Stack:at C", "2")]


def test_dump_count_line_may_be_missing_or_in_an_earlier_block(spark):
    dump = "5 threads with trace\n\nnoise\nStack:\nat A\n\nStack:\nat B\n 7 threads with trace x\n\n\nStack:\n\n"
    stacks = column(spark, [dump], text.dump_stacks)[0]
    assert [(s.stack, s.threads) for s in stacks] == [
        ("Stack:at A", "5"), ("Stack:at B 7 threads with trace x", "7"), ("Stack:", None)]


@pytest.mark.parametrize("cut", [None, 2, 5])
def test_stacks_from_lines_are_those_of_the_whole_dump(spark, cut):
    """Random dumps: lines of every kind in any order, in segments shorter than a block."""
    rng = random.Random(11)
    kinds = ["", "", "Stack:", "x Stack: y", "at spark", " 7 threads with trace", "9 threads with trace z", "noise"]
    texts = {d: [rng.choice(kinds) for _ in range(rng.randint(0, 60))] for d in range(25)}
    rows = [(d, i, line) for d, some in texts.items() for i, line in enumerate(some)]
    found = dumps.stacks_of_lines(spark.createDataFrame(rows, "d long, line_no long, line string").repartition(5), ["d"], cut)
    whole = spark.createDataFrame([(d, "".join(f"{x}\n" for x in some)) for d, some in texts.items()], "d long, value string")
    whole = whole.select("d", F.explode(text.dump_stacks(F.col("value"))).alias("s")).select("d", "s.*")
    got = sorted(map(str, found.collect()))
    assert got == sorted(map(str, whole.collect())) and len(got) > 40


def test_long_dump_does_not_exhaust_the_matcher(spark):
    dump = "9 threads with trace\nStack:\n" + "at frame\n" * 200_000 + "\n"
    size = column(spark, [dump], lambda c: F.length(F.get(text.dump_stacks(c), F.lit(0))["stack"]))
    assert size == [6 + 8 * 200_000]


def test_function_lines(spark):
    got = column(spark, ["  a.b *** 3 \n", "x", " *** 1", "a***b***c"], lambda c: text.drop_thread_count(text.strip(c)))
    assert got == ["a.b ", "x", "", "a"]


KEYS = [
    ("abc", "bcde", 0.5, True, "b->c->d->e->"),
    ("abc", "abcd", 0.75, False, "a->b->c->"),
    ("cab", "abcde", 0.6, False, "a->b->c->"),
    ("a", "", 0.0, True, ""),
    ("", "", None, False, ""),
]


def test_similarity_and_key(spark):
    rows = [(list(a), list(b)) for a, b, *_ in KEYS] + [([], [""])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    change = ph.changed(F.col("a"), F.col("b"), 0.6)
    got = df.select(ph.similarity(F.col("a"), F.col("b")), change, ph.phase_key(F.col("a"), F.col("b"), change)).collect()
    assert [tuple(r) for r in got] == [k[2:] for k in KEYS] + [(0.0, True, "->")]


@pytest.mark.parametrize("cut", [None, 2])
def test_triplets_and_stride(spark, cut):
    df = spark.createDataFrame([("c", t, float(t), 0.0, ["f"]) for t in range(1, 6)], "cluster string, tick long, cpu double, mem double, funcs array<string>")
    got = ticks.triplets(df, Settings(), cut).orderBy("tick_no").collect()
    assert [(r.tick_no, r.cpu_prev2, r.cpu_prev1, r.cpu) for r in got] == [(1, 0.0, 1.0, 2.0), (2, 2.0, 3.0, 4.0)]


def visits_of(spark, settings, n=8, cut=None):
    rows = [("c", t, t, "p", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0) for t in range(1, n + 1)]
    df = spark.createDataFrame(rows, "cluster string, tick long, tick_no long, phase string, cpu double, cpu_prev1 double, cpu_prev2 double, mem double, mem_prev1 double, mem_prev2 double")
    return phases.visits(df.withColumn("phase_id", F.md5("phase")), settings, cut).orderBy("tick").collect()


def test_versions(spark):
    for cut in (None, 3):
        got = visits_of(spark, Settings(), cut=cut)
        assert [r.version for r in got] == [0, 0, 0, 1, 1, 1, 2, 2]
        assert [r.seen for r in got] == [False] + [True] * 7
        # The first tick of the first variant leaves no trace, so its cycle starts at the second.
        old = visits_of(spark, Settings(variant="v1"), n=9, cut=cut)
        assert [r.version for r in old] == [0, 0, 0, 0, 0, 1, 1, 1, 1]


POINTS = [(10.0, 20.0, 15.0), (20.0, 30.0, 30.0), (40.0, 10.0, 35.0)]


def lasso_columns(spark, points):
    names = [tuple(f"{p}{i}" for p in "aby") for i in range(len(points))]
    df = spark.createDataFrame([tuple(v for p in points for v in p)], ", ".join(f"{c} double" for n in names for c in n))
    return tuple(with_lasso(df, {"r": names}, 0.1).select("r_w_prev2", "r_w_prev1", "r_intercept").first())


def test_lasso(spark):
    for fit in (fit_points(POINTS, 0.1), lasso_columns(spark, POINTS)):
        assert fit == pytest.approx((0.87275, 0.62125, -6.1225), abs=1e-9)
        assert fit[0] * 30 + fit[1] * 25 + fit[2] == pytest.approx(35.59125)
    constant = [(10.0, 10.0, y) for y in (5.0, 6.0, 7.0)]
    for fit in (fit_points(constant, 0.1), lasso_columns(spark, constant)):
        assert fit == (0.0, 0.0, 6.0)


def test_lasso_is_optimal(spark):
    import random

    rng = random.Random(2)
    for _ in range(300):
        n = rng.choice([3, 8])
        scale = rng.choice([0.2, 5, 100])
        pts = [tuple(round(rng.random() * scale, 1) for _ in range(3)) for _ in range(n)]
        w1, w2, b = fit_points(pts, 0.1)
        rest = [y - w1 * x1 - w2 * x2 - b for x1, x2, y in pts]
        assert abs(sum(rest)) < 1e-6 * n * max(scale, 1)
        for w, k in ((w1, 0), (w2, 1)):
            slope = sum(r * p[k] for r, p in zip(rest, pts)) / n
            if w == 0:
                assert abs(slope) <= 0.1 + 1e-6
            else:
                assert slope == pytest.approx(math.copysign(0.1, w), abs=1e-5)


def test_lasso_against_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    pts = POINTS + [(5.0, 7.0, 9.0), (33.0, 21.0, 12.0)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pts, "a double, b double, label double"))
    model = LinearRegression(regParam=0.1, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=1000).fit(df)
    assert (*model.coefficients, model.intercept) == pytest.approx(fit_points(pts, 0.1), abs=1e-5)


def agg_batches(spark, n):
    rows = [("c", "p", v, *[10.0, 20.0, 30.0], *[20.0, 30.0, 40.0], *[0.0] * 3, *[0.0] * 9) for v in range(1, n + 1)]
    names = [f"{r}_{p}_{i}" for r in ("cpu", "mem") for p in ("prev2", "prev1", "curr") for i in range(3)]
    return spark.createDataFrame(rows, "cluster string, phase_id string, version long, " + ", ".join(f"{x} double" for x in names))


def test_agg(spark):
    got = models.agg_models(agg_batches(spark, 700), Settings(variant="v1", algo="agg")).orderBy("version").collect()
    want, m = [], 0.0
    for _ in got:
        m = (150 + m) / 7
        want.append(m)
    assert [r.cpu_mean for r in got] == pytest.approx(want, rel=1e-12)
    assert want[:2] == pytest.approx([21.428571, 24.489796], abs=1e-6)


def test_agg_keeps_a_faded_value_above_zero(spark):
    rows = agg_batches(spark, 240)
    once = rows.withColumns({c: F.when(F.col("version") == 1, F.col(c)).otherwise(0.0) for c in rows.columns[3:]})
    got = models.agg_models(once, Settings(variant="v1", algo="agg")).orderBy("version").collect()
    m = 150 / 7
    for r in got:
        assert r.cpu_mean == pytest.approx(m, rel=1e-9) and r.cpu_mean > 0
        m /= 7


RUN = [("c", 1, 0.0, 0.0, 0.0, 0.0), ("c", 2, 93.30, 14.90, 0.0, 0.0), ("c", 3, 100.0, 10.40, 83.18, 14.90)]
RUN_SCHEMA = "cluster string, tick_no long, cpu double, mem double, predicted_cpu double, predicted_mem double"


def test_accuracy(spark):
    df = spark.createDataFrame(RUN, RUN_SCHEMA)
    assert tuple(anomaly.smape_accuracy(df, ["cluster"]).first())[1:] == pytest.approx((63.605925, 60.737813), abs=1e-6)
    ticks_ = df.withColumns({"idle": F.lit(True), "seen": F.lit(False)})
    for cut in (None, 2):
        got = anomaly.scored(ticks_, Settings(), cut).orderBy("tick_no").collect()
        assert got[0].acc_cpu == 100.0 and got[2].acc_cpu == pytest.approx(63.605925, abs=1e-6)
        old = anomaly.scored(ticks_, Settings(variant="v1"), cut).orderBy("tick_no").collect()
        assert math.isnan(old[0].acc_cpu) and old[1].acc_cpu == 100.0


STEPS = [
    (False, True, 100.0, 10.4, 83.18, 14.9, -1, 25.211275),
    (False, True, 5.0, 0.0, 0.0, 0.0, 1, 249950.0),
    (False, False, 9.99, 0.0, 9.99, 0.0, 1, 0.0),
    (False, False, 10.0, 0.0, 10.0, 0.0, -1, 0.0),
    (True, False, 0.0, 0.0, 0.0, 0.0, 0, 0.0),
]


def test_anomaly_steps(spark):
    df = spark.createDataFrame([r[:6] for r in STEPS], "idle boolean, seen boolean, cpu double, mem double, predicted_cpu double, predicted_mem double")
    got = anomaly.anomaly_steps(df).select("step", "mape").collect()
    assert [r.step for r in got] == [r[6] for r in STEPS]
    assert [r.mape for r in got] == pytest.approx([r[7] for r in STEPS])


@pytest.mark.parametrize("cut", [None, 3])
def test_alert_tick(spark, cut):
    for cpus, want in (([1.0] * 7, 6), ([50.0] + [1.0] * 8, 8)):
        rows = [("c", i + 1, c, 0.0, c, 0.0, False, False) for i, c in enumerate(cpus)]
        df = spark.createDataFrame(rows, RUN_SCHEMA + ", idle boolean, seen boolean")
        got = anomaly.scored(df, Settings(), cut, stop_at_first=True).orderBy("tick_no").collect()
        assert [r.tick_no for r in got if r.alert] == [want] and len(got) == want


def points(spark, values, minutes=5):
    rows = [(i * minutes, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "m int, cpu double")
    time = F.expr("timestampadd(MINUTE, m, TIMESTAMP '2021-03-21 19:45:00')")
    return df.select(time.alias("time"), F.lit("runner-x").alias("host"), F.lit("e").alias("experiment_name"), "cpu")


WINDOWS = [0.88511, 5.07138, 1.57483, 3.15904, 3.58356, 3.01275, 2.63378, 2.04534]


def test_report_mean_of_means(spark):
    df = points(spark, [*WINDOWS, 0.0, None])
    windows = reports.window_means(df, ("cpu",), ["host"])
    assert windows.count() == len(WINDOWS)
    assert reports.mean_of_means(windows, ["host"]).first()["mean"] == pytest.approx(2.7457241, abs=1e-5)
    calls = reports.report(df, "cpu", "avg", ["host"]).collect()
    assert len(calls) == len(WINDOWS) + 1
    assert [r.value for r in calls if r.window_start is None] == pytest.approx([2.7457241], abs=1e-5)
    one = {op: reports.report(df, "cpu", op, ["host"]).first()["value"] for op in ("max", "min", "freq")}
    assert one == {"max": 5.07138, "min": 0.0, "freq": 9.0}
    with pytest.raises(ValueError):
        reports.report(df, "cpu", "median")


def test_report_of_no_points_is_empty(spark):
    df = points(spark, [1.0]).where("false")
    assert reports.report(df, "cpu", "avg", ["host"]).count() == 0
    assert reports.report(df, "cpu", "max", ["host"]).count() == 0


STATS = """kmeans

### Accuracy Rates ###
CPU Prediction Accuracy: 80.000
MEM Prediction Accuracy: 90.000

kmeans

### Accuracy Rates ###
CPU Prediction Accuracy: 90.000
MEM Prediction Accuracy: 94.000
"""


def stats(spark, content, **kw):
    lines = [("lasso", i, x) for i, x in enumerate(content.split("\n"))]
    return compare.parse_stats(spark.createDataFrame(lines, "algo string, line_no long, line string"), ("CPU", "MEM"), **kw)


def uneven(spark, content):
    lines = spark.createDataFrame([("lasso", i, x) for i, x in enumerate(content.split("\n"))], "algo string, line_no long, line string")
    return compare.unequal_repeats(stats(spark, content), compare.named_workloads(lines)).count()


def test_stats_file(spark):
    for cut in (None, 3):
        means = compare.workload_means(stats(spark, STATS, segment_rows=cut), ("CPU", "MEM")).collect()
        assert [tuple(r) for r in means] == [("lasso", "kmeans", 85.0, 92.0, 2)]
    assert uneven(spark, STATS) == 0
    assert uneven(spark, STATS + "\npagerank\nCPU Prediction Accuracy: 1\n") == 1
    assert uneven(spark, STATS + "\nempty\n") == 1


def test_failure_line_drops_what_came_before(spark):
    content = "a\nCPU Prediction Accuracy: 1\nrun failure\nMEM Prediction Accuracy: 2\na\nCPU Prediction Accuracy: 3\nrun failure\n"
    got = stats(spark, content, failures=("run failure",)).collect()
    assert [(r.workload, r.CPU, r.MEM) for r in got] == [("a", None, 2.0)]
    assert stats(spark, content).count() == 2


def test_comparison_has_nulls_for_missing_workloads(spark):
    means = spark.createDataFrame([("x", "a", 1.0), ("y", "a", 2.0), ("y", "b", 3.0)], "algo string, workload string, CPU double")
    got = sorted(map(tuple, compare.compare(means, "CPU", ["x", "y"]).collect()))
    assert got == [("a", 1.0, 2.0), ("b", None, 3.0)]


@pytest.mark.parametrize("cut", [None, 2])
def test_workload_log(spark, cut):
    rows = [("c", "w", i + 1, p) for i, p in enumerate([7, 7, None, 7, 8])]
    df = spark.createDataFrame(rows, "cluster string, worker string, tick long, pid long")
    assert [(r.tick, r.pid) for r in runs.workload_changes(df, cut).orderBy("tick").collect()] == [(1, 7), (5, 8)]
    assert [r.sample_no for r in runs.sample_numbers(df, cut).orderBy("tick").collect()] == [0, 1, None, 0, 1]


PROCESSES = [("h", 1, None, 0.0, 0.0), ("h", 42, 1, 5.0, 1.0), ("h", 43, 42, 7.0, 2.0), ("h", 9, 1, 1.0, 1.0), ("h", 0, 0, 0.0, 0.0)]
LINES = ["python3/42/0 1.5 2.0", "ssh/99/0 0.5 0.25", "java/7/0 9 9", "short 1", "Refreshing:", "Refreshing:", "x/142/0 1 1", "Refreshing:", "python3/43/0 1 1"]


@pytest.mark.parametrize("cut", [None, 3])
def test_traffic(spark, cut):
    procs = spark.createDataFrame(PROCESSES, "host string, pid long, ppid long, cpu double, mem double")
    watched = traffic.process_tree(procs, F.col("pid") == 42)
    assert sorted(r.pid for r in watched.collect()) == [42, 43]
    lines = [("h", i, x) for i, x in enumerate(LINES)] + [("other", 0, "ssh/1/0 5 5"), ("other", 1, "Refreshing:")]
    chunks = traffic.chunked(spark.createDataFrame(lines, "host string, line_no long, line string"), ["host"], cut)
    got = {(r.host, r.chunk): (r.upload, r.download, r.cpu, r.mem) for r in traffic.usage_by_chunk(chunks, watched, ["host", "chunk"]).collect()}
    assert got == {("h", 0): (2.0, 2.25, 5.0, 1.0), ("h", 1): (0, 0, 0, 0), ("h", 2): (1.0, 1.0, 5.0, 1.0), ("other", 0): (0, 0, 0, 0)}
    exact = {(r.host, r.chunk): r.upload for r in traffic.usage_by_chunk(chunks, watched, ["host", "chunk"], exact=True).collect()}
    assert exact[("h", 2)] == 0.0


def test_deep_process_tree(spark):
    rows = [("h", i, i - 1 if i else None, 0.0, 0.0) for i in range(200)]
    procs = spark.createDataFrame(rows, "host string, pid long, ppid long, cpu double, mem double")
    got = sorted(r.pid for r in traffic.process_tree(procs, F.col("pid") == 50).collect())
    assert got == list(range(50, 200))


def test_process_lines(spark):
    df = spark.createDataFrame([(1, "5,6"), (None, "5,6"), (1, "PID CPU MEM")], "pid long, line string")
    got = [r[0] for r in df.select(text.live_resource_line(F.col("pid"), F.col("line"))).collect()]
    assert got == ["5,6", "0,0", "0,0"]


def test_blocks(spark):
    df = spark.createDataFrame([("a\n# b\nc\n# d",), ("# x",), ("",)], "t string")
    got = [r.blocks for r in text.with_blocks(df, "t", lambda line: line.startswith("#")).collect()]
    assert got == [[["a"], ["# b", "c"], ["# d"]], [["# x"]], [[""]]]


def test_closed_chunks(spark):
    got = column(spark, ["a\nb\nRefreshing:\nRefreshing:\nc\nRefreshing:\nopen\n", "open\n", "Refreshing:\n"], text.closed_chunks)
    assert got == [["a\nb\n", "", "c\n"], [], [""]]


def test_mape_denominator_is_the_first_list(spark):
    df = spark.createDataFrame([(10.0, 5.0)], "p double, a double")
    assert df.select(errors.mape([F.col("p")], [F.col("a")])).first()[0] == 50.0


def test_local_time(spark):
    df = spark.createDataFrame([("2021-03-21T23:45:00Z",)], "t string")
    got = df.select(F.date_format(reports.local_time(reports.utc_text_to_time(F.col("t")), "America/Toronto"), "yyyy-MM-dd HH:mm:ss"))
    assert got.first()[0] == "2021-03-21 19:45:00"


def test_polls_keep_the_newest_sample_of_an_interval(spark):
    rows = [("c", "w1", 0.1, "1,1"), ("c", "w1", 1.9, "2,2"), ("c", "w1", 2.0, "3,3"), ("c", "w2", 3.9, "4,4"), ("c", "w2", -0.5, "5,5")]
    df = spark.createDataFrame(rows, "cluster string, worker string, s double, resource_data string")
    df = df.select("cluster", "worker", F.timestamp_seconds("s").alias("ts"), "resource_data")
    got = {(r.worker, r.tick): r.resource_data for r in ticks.polled(df).collect()}
    assert got == {("w1", 0): "2,2", ("w1", 1): "3,3", ("w2", 1): "4,4", ("w2", -1): "5,5"}


def test_similarity_is_symmetric_and_a_share(spark):
    import random

    rng = random.Random(4)
    sets = [sorted({rng.choice("abcdefg") for _ in range(rng.randint(0, 6))}) for _ in range(80)]
    df = spark.createDataFrame(list(zip(sets, reversed(sets))), "a array<string>, b array<string>")
    for x, y in df.select(ph.similarity(F.col("a"), F.col("b")), ph.similarity(F.col("b"), F.col("a"))).collect():
        assert x == y and (x is None or 0 <= x <= 1)


def test_unknown_settings_are_refused():
    for bad in ({"algo": "ridge"}, {"variant": "v3"}, {"stride": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_many_fits_at_once_equal_single_fits():
    rng = np.random.default_rng(5)
    points = rng.integers(-4, 5, (400, 8, 3)).astype(float)
    points[::7] = 1.0
    points[1::7, :, 1] = points[1::7, :, 0]
    found = fit_many(points, 0.1)
    assert [tuple(f) for f in found] == [pytest.approx(fit_points([tuple(p) for p in one], 0.1), abs=1e-12) for one in points]


def test_synthetic_columns_equal_single_values():
    phases, versions = np.array([0, 0xFFFFFFFF, 77]), np.array([1, 10**6, 3])
    found = replay.synthetic_columns(phases, versions, 1, 4, 9)
    for i, (p, v) in enumerate(zip(phases, versions)):
        single = [replay.synthetic_value(f"{p:08x}", int(v), 1, place, 9) for place in range(8)]
        assert found[i].ravel().tolist() == single


def test_gathered_keeps_equal_samples_and_distinct_functions(spark):
    rows = [("c", 1, "w0", "1,2", ["f *** 3", " g"]), ("c", 1, "w0", "1,2", ["f *** 4"]), ("c", 1, "w1", "x", None), ("c", 2, "w0", "3,4", [])]
    samples = spark.createDataFrame(rows, "cluster string, tick long, worker string, resource_data string, threaddump_data array<string>")
    expected = spark.createDataFrame([("c", "w0"), ("c", "w1")], "cluster string, worker string")
    found = ticks.gathered(samples)
    got = {r.tick: r.lines for r in found.collect()}
    assert got == {1: ["f ", "g"], 2: []}
    got = sorted(map(tuple, ticks.readings(found, expected).collect()))
    assert got == [("c", 1, "w0", "1,2"), ("c", 1, "w0", "1,2"), ("c", 1, "w1", "x"), ("c", 2, "w0", "3,4"), ("c", 2, "w1", "0,0")]


def test_set_ids_tell_sets_apart(spark):
    df = spark.createDataFrame([(["ab"], []), (["a", "b"], []), (["a1:b"], []), ([], ["ab"]), ([], [])], "funcs array<string>, counted array<string>")
    ids = [r.id for r in df.select(ticks.set_id(["funcs", "counted"]).alias("id")).collect()]
    assert len(set(ids)) == 5


def test_samples_are_shuffled_once(spark):
    """Readings and functions become rows behind the only shuffle, not one record each in front of it."""
    rows = [("c", 1, "w0", "1,2", ["f *** 3"])]
    samples = spark.createDataFrame(rows, "cluster string, tick long, worker string, resource_data string, threaddump_data array<string>")
    plan = ticks.gathered(samples)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_processes_and_models_are_not_broadcast(spark):
    procs = spark.createDataFrame([("h", 1, None), ("h", 2, 1)], "host string, pid long, ppid long").withColumns({"cpu": F.lit(1.0), "mem": F.lit(1.0)})
    watched = traffic.process_tree(procs, F.col("pid") == 1)
    lines = spark.createDataFrame([("h", 0, "java/1/0 1 2")], "host string, chunk long, line string")
    plan = watched._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = traffic.usage_by_chunk(lines, watched, ["host", "chunk"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 3


@pytest.mark.parametrize("cut", [None, 2, 5])
def test_measured_ticks_equal_filled_rows(spark, cut):
    """Means without a row per silent worker, against filling every worker's rows: gaps, runs of malformed lines, strangers, equal samples."""
    rng = random.Random(7)
    lines = ["3,4", "10,", "x,7", "1,2,3", "", "0.5,2", "8,y"]
    rows = [
        (c, f"w{w}", t, rng.choice(lines), rng.choice([None, [], [" f *** 1\n"], ["f *** 2", "\tg "]]))
        for c in ("a", "b") for t in range(1, 60) if t % 11 for w in range(4) if rng.random() < 0.6
    ]
    rows += [("a", "w0", 5, "3,4", ["f *** 1"])] * 2 + [("z", "w0", 1, "3,4", [])]
    rows = [r for r in rows if r[:3] != ("a", "w0", 5) or r[3] == "3,4"]
    samples = spark.createDataFrame(rows, SAMPLES)
    # The worker w3 is not configured, w9 is never heard of, and the cluster z has no workers.
    expected = spark.createDataFrame([(c, w) for c in "ab" for w in ("w0", "w1", "w2", "w9")], "cluster string, worker string")
    plain = ticks.parse_resources(ticks.readings(ticks.gathered(samples), expected))
    for variant, with_counts in (("v1", True), ("v2", False), ("v2", True)):
        found = ticks.measured(samples, expected, with_counts)
        assert "z" not in {r.cluster for r in found.collect()}
        got = ticks.measured_ticks(found, Settings(variant=variant), cut)
        want = ticks.cluster_means(plain if variant == "v1" else ticks.fill_forward(plain, cut), expected, variant == "v1")
        sets = ticks.function_union(samples, variant == "v1").withColumnRenamed("tick", "at").withColumnRenamed("cluster", "of")
        want = want.join(sets, (F.col("of") == F.col("cluster")) & (F.col("at") == F.col("tick")), "left")
        flag = ["malformed"] if variant == "v1" else []
        names = ["cluster", "tick", "cpu", "mem", *flag, F.coalesce("funcs", F.array().cast("array<string>")).alias("funcs")]
        if flag:
            names.append(F.coalesce("counted", F.array().cast("array<string>")).alias("counted"))
        listed = [sorted(map(str, d.select(names).collect())) for d in (got, want)]
        assert len(listed[0]) > 80 and listed[0] == listed[1]


def test_silent_workers_have_no_rows(spark):
    """The fill of malformed lines sees the malformed ones only, however many workers are silent."""
    expected = spark.createDataFrame([("c", f"w{i}") for i in range(50)], "cluster string, worker string")
    samples = spark.createDataFrame([("c", "w1", t, "x,1" if t == 3 else "4,1", []) for t in range(1, 6)], SAMPLES)
    found = ticks.measured(samples, expected)
    assert [tuple(r) for r in ticks.filled_sums(found, 2).collect()] == [("c", 3, 4.0, None)]


def test_function_names_equal_stripping_and_cutting(spark):
    given = ["f *** 3\n", "  *** 3", " f ", "\tf *** 1 *** 2 ", "***", "", None, " g\n *** 4", "f ** 3 \n"]
    want = column(spark, given, lambda c: text.drop_thread_count(text.strip(c)))
    assert column(spark, given, text.function_name) == want


def test_one_row_back_needs_no_sorted_ends(spark):
    """Ends of segments are aggregated in front of the shuffle if nothing looks two rows back."""
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "k string, i long, v double")
    once = scan(rows, ["k"], "i", lags={"v1": ("v", 1)}, segment_rows=2)
    twice = scan(rows, ["k"], "i", lags={"v1": ("v", 1), "v2": ("v", 2)}, segment_rows=2)
    windows = [d._jdf.queryExecution().sparkPlan().toString().count("Window ") for d in (once, twice)]
    assert windows[0] < windows[1]
    assert sorted(r.v1 for r in once.collect() if r.i) == [float(i) for i in range(8)]


def test_written_ticks_are_not_written_again(spark, monkeypatch):
    """Ticks have the ids of their sets when they are written, so the scan over them starts from that table."""
    samples, expected = polls(spark, {t: ["30,10", "60,20", "90,30"] for t in range(1, 5)})
    written = store(ticks.cluster_ticks(samples, expected), "ticks")
    names = []
    monkeypatch.setattr(ordered, "stored", lambda df, name: (df if getattr(df, "_phasebeat_stored", None) else names.append(name) or df))
    rows, sets = ticks.ordered_triplets(written, Settings(stride=1), 2)
    assert names == [] and rows.count() == 4 and sets.count() == 1
    assert "set_id" not in ticks.last_two(written).columns


def test_lasso_chooses_by_numbers(spark):
    """No candidate is put into a struct of its own, and of equal ones the first is taken."""
    points = {"cpu": [(f"a{i}", f"b{i}", f"y{i}") for i in range(3)]}
    row = [float(v) for v in (1, 1, 1, 2, 2, 2, 4, 4, 4)]
    df = spark.createDataFrame([tuple(row), (0.0,) * 9], ", ".join(f"{c}{i} double" for i in range(3) for c in "aby"))
    found = with_lasso(df, points, 0.1)
    assert "array_min" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.cpu_w_prev2, r.cpu_w_prev1, r.cpu_intercept) for r in found.collect())
    want = sorted(fit_points([tuple(p[i : i + 3]) for i in (0, 3, 6)], 0.1) for p in (row, [0.0] * 9))
    assert got == [pytest.approx(w, abs=1e-12) for w in want]
