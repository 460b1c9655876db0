"""The command line end to end, on small files."""

import pytest
from pyspark.sql import functions as F
from test_fixtures import STATS
from test_watch import CLUSTERS, frames, polls_of

from phasebeat.__main__ import main
from phasebeat.operators import reports
from phasebeat.plans.comparison import compare_files
from phasebeat.sources import tables
from phasebeat.workspace import new_dir


def test_watch(spark, tmp_path):
    samples, _ = frames(spark, polls_of(9, 50))
    samples.write.json(str(tmp_path / "samples"))
    (tmp_path / "workers.csv").write_text("".join(f"{c},{w}\n" for c, ws in CLUSTERS.items() for w in ws))
    main(["watch", "--samples", str(tmp_path / "samples"), "--workers", str(tmp_path / "workers.csv"), "--out", str(tmp_path / "out")])
    scored = spark.read.parquet(str(tmp_path / "out" / "scored"))
    assert scored.count() == 3 * 25
    assert spark.read.parquet(str(tmp_path / "out" / "models")).count() > 0


def test_watch_report_and_compare(spark, tmp_path, capfd):
    """Two runs, the second going on from the phases of the first; then a report on their points and a comparison."""
    samples, _ = frames(spark, polls_of(9, 50))
    (tmp_path / "workers.csv").write_text("".join(f"{c},{w}\n" for c, ws in CLUSTERS.items() for w in ws))
    for version, ticks in ((1, "tick <= 30"), (2, "tick > 30")):
        samples.where(ticks).write.json(str(tmp_path / f"in{version}"))
        main(["watch", "--samples", str(tmp_path / f"in{version}"), "--workers", str(tmp_path / "workers.csv"), "--out", str(tmp_path / f"out{version}"),
              "--phases", str(tmp_path / "phases"), "--version", str(version), "--points", str(tmp_path / "p"), "--host", "runner-x", "-name", "e",
              "--stats", str(tmp_path / "stats"), "--workload", "kmeans", "--algo", "simple", "--confidence_limit", "3"])
    scored = spark.read.parquet(str(tmp_path / "out2" / "scored"))
    assert scored.where("seen").count() > 0
    main(["report", "--points", str(tmp_path / "p"), "-uid", "x", "-name", "e", "--all"])
    printed = capfd.readouterr().out
    total = scored.count() + spark.read.parquet(str(tmp_path / "out1" / "scored")).count()
    assert f"Number of cpu predictions for x: {total}" in printed
    cluster = next(iter(CLUSTERS))
    files = sorted(str(p) for p in (tmp_path / "stats" / f"cluster={cluster}").glob("part-*"))
    assert len(files) == 2
    tables_ = compare_files(spark, {"one": files[0], "two": files[1]}, ("CPU", "MEM"))
    assert [r.workload for r in tables_["CPU"].collect()] == ["kmeans"]


def test_report_prints_every_row(spark, tmp_path, capfd):
    root = new_dir(spark, "points")
    time = F.expr("timestampadd(MINUTE, 5 * id, TIMESTAMP '2021-03-21 19:45:00')").alias("time")
    tags = [F.lit("runner-x").alias("host"), F.lit("e").alias("experiment_name")]
    tables.write_points(spark.range(1500).select(time, *tags, F.lit(1.0).alias("latency")), root, "prediction_latency")
    main(["report", "--points", root, "-op", "latency", "-m", "prediction_latency"])
    assert sum("runner-x" in x for x in capfd.readouterr().out.splitlines()) == 1501


def test_watch_takes_timed_samples(spark, tmp_path):
    samples, _ = frames(spark, polls_of(9, 50))
    (tmp_path / "workers.csv").write_text("".join(f"{c},{w}\n" for c, ws in CLUSTERS.items() for w in ws))
    samples.write.json(str(tmp_path / "ticks"))
    samples.withColumn("ts", F.timestamp_seconds(F.col("tick") * 2 + 0.5)).drop("tick").write.json(str(tmp_path / "timed"))
    for name, more in (("ticks", []), ("timed", ["--timed"])):
        main(["watch", "--samples", str(tmp_path / name), "--workers", str(tmp_path / "workers.csv"), "--out", str(tmp_path / f"out-{name}"), *more])
    one, other = (spark.read.parquet(str(tmp_path / f"out-{n}" / "scored")).select("cluster", "tick", "confidence", "phase_id") for n in ("ticks", "timed"))
    assert one.count() == other.count() == 75 and one.exceptAll(other).count() == 0


@pytest.mark.parametrize("go_on", [True, False])
def test_live(spark, tmp_path, capfd, go_on):
    """A workload that uses next to nothing, in ever new phases, alerts."""
    rows = [("c", "w", i, "1,1", [f"f{i}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "cluster string, worker string, tick long, resource_data string, threaddump_data array<string>")
    df = df.withColumn("ts", F.expr("timestampadd(SECOND, tick * 2, TIMESTAMP '2024-01-01 00:00:00')")).drop("tick")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    (tmp_path / "workers.csv").write_text("c,w\n")
    args = ["live", "--samples", str(tmp_path / "in"), "--workers", str(tmp_path / "workers.csv"), "--points", str(tmp_path / "p"),
            "--checkpoint", str(tmp_path / "check"), "--host", "runner-x", "-name", "e", "--delay", "0 seconds", "--available"]
    main(args + ["--go_on"] if go_on else args)
    assert "Anomaly Detected" in capfd.readouterr().out
    points, accuracy, alerts, *steps = (
        tables.read_points(spark, str(tmp_path / "p"), name, "runner-x", "e")
        for name in ("predictions", "accuracy", "alerts", *reports.LATENCY_POINTS[1:])
    )
    # The last interval is open, and every second snapshot is evaluated; the sixth alerts, and the cluster ends there.
    assert points.count() == accuracy.count() == (19 if go_on else 6)
    assert points.agg(F.countDistinct("time")).first()[0] == points.count()
    assert alerts.agg(F.min("confidence"), F.count("*")).first()[:] == (6, 14 if go_on else 1)
    assert all(s.count() == points.count() and s.where("latency >= 0 AND latency < 10").count() == s.count() for s in steps)
    # The latencies of this run can be reported on.
    for name in reports.LATENCY_POINTS:
        main(["report", "--points", str(tmp_path / "p"), "-uid", "x", "-name", "e", "-op", "latency", "-m", name])
        assert "runner-x" in capfd.readouterr().out, name


def test_live_options(spark, tmp_path):
    """Limits reach the state: with a high limit nothing alerts, with a stride of one every snapshot is evaluated."""
    rows = [("c", "w", i, "1,1", [f"f{i}"]) for i in range(12)]
    df = spark.createDataFrame(rows, "cluster string, worker string, tick long, resource_data string, threaddump_data array<string>")
    df = df.withColumn("ts", F.expr("timestampadd(SECOND, tick * 2, TIMESTAMP '2024-01-01 00:00:00')")).drop("tick")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    (tmp_path / "workers.csv").write_text("c,w\nc,silent\n")
    main(["live", "--samples", str(tmp_path / "in"), "--workers", str(tmp_path / "workers.csv"), "--points", str(tmp_path / "p"),
          "--checkpoint", str(tmp_path / "check"), "--host", "runner-x", "--delay", "0 seconds", "--available", "--stride", "1",
          "--confidence_limit", "100", "--empty_function", "--algo", "simple", "--partitions", "2"])
    assert tables.read_points(spark, str(tmp_path / "p"), "predictions").count() == 11
    assert not list((tmp_path / "p" / "alerts").glob("experiment_name=*"))


def test_traffic(spark, tmp_path, capfd):
    """From a log and a process table to the resource section of a report."""
    folder = tmp_path / "logs" / "host=runner-x"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("java/42/0 1.5 2\njava/7/0 9 9\nRefreshing:\nssh/7/0 1 1\nbroken\n")
    (tmp_path / "processes.csv").write_text("runner-x,42,,10,1\nrunner-x,43,42,20,2\nrunner-x,7,,99,9\n")
    (tmp_path / "main.csv").write_text("runner-x,42\n")
    args = ["traffic", "--logs", str(tmp_path / "logs"), "--processes", str(tmp_path / "processes.csv"), "--main", str(tmp_path / "main.csv"),
            "--points", str(tmp_path / "p"), "--checkpoint", str(tmp_path / "check"), "-name", "e", "--available"]
    main(args)
    (folder / "b.txt").write_text("java/43/0 3 4\nRefreshing:\nrest\n")
    main(args)
    points = tables.read_points(spark, str(tmp_path / "p"), reports.RESOURCE_POINTS, "runner-x", "e").collect()
    assert sorted((r.upload, r.download, r.cpu, r.mem) for r in points) == [(1.5, 2.0, 10.0, 1.0), (4.0, 5.0, 20.0, 2.0)]
    main(["report", "--points", str(tmp_path / "p"), "-uid", "x", "-name", "e", "-op", "max", "-m", "cpu"])
    assert "20.0" in capfd.readouterr().out


def test_compare(spark, tmp_path, capfd):
    for name, text in (("a", STATS), ("b", STATS.replace("90.000", "70.000"))):
        (tmp_path / name).write_text(text)
    out = tmp_path / "cmp"
    main(["compare", "--stats", "CPU,MEM", "--stat_files", f"{tmp_path}/a,{tmp_path}/b", "--algos", "x,y", "--save_path", str(out)])
    rows = spark.read.option("header", True).csv(str(out / "CPUx_y.csv")).collect()
    assert [tuple(r) for r in rows] == [("kmeans", "85.0", "75.0")]
    (tmp_path / "a").write_text(STATS + "\nother\nCPU Prediction Accuracy: 1\n")
    with pytest.raises(ValueError, match="repeats: x"):
        compare_files(spark, {"x": f"{tmp_path}/a"}, ("CPU",))


def points(spark):
    time = F.expr("timestampadd(MINUTE, id, TIMESTAMP '2021-03-21 19:45:00')")
    fields = {
        reports.RESOURCE_POINTS: reports.RESOURCE_METRICS,
        reports.PREDICTION_POINTS: reports.PREDICTION_METRICS,
        reports.ACCURACY_POINTS: reports.ACCURACY_METRICS,
        **{n: ("latency",) for n in reports.LATENCY_POINTS},
    }
    for name, metrics in fields.items():
        yield name, spark.range(12).select(
            time.alias("time"), F.lit("runner-x").alias("host"), F.lit("e").alias("experiment_name"),
            *[(F.col("id") % 4).cast("double").alias(m) for m in metrics],
        )


def test_report(spark, tmp_path, capfd):
    root = new_dir(spark, "points")
    for name, rows in points(spark):
        tables.write_points(rows, root, name)
    main(["report", "--points", root, "-uid", "x", "-name", "e", "--all", "--out", str(tmp_path / "all")])
    lines = [r.line for r in spark.read.option("header", True).csv(str(tmp_path / "all")).collect()]
    assert "Max cpu for x: 3.00000" in lines and "Number of mem predictions for x: 12" in lines
    # Twelve minutes give three windows, each with a mean above zero.
    assert sum(x.startswith("2021-03-21 19:45:00: ") for x in lines) == 4 + 4 + 4 + 2
    for op in ("max", "min", "avg"):
        main(["report", "--points", root, "-uid", "x", "-name", "e", "-op", op, "-m", "cpu"])
    main(["report", "--points", root, "-op", "freq"])
    main(["report", "--points", root, "-op", "latency", "-m", "prediction_latency"])
    with pytest.raises(SystemExit):
        main(["report", "--points", root])


def test_timed_step(spark):
    root = new_dir(spark, "points")
    with tables.timed_step(spark, root, "prediction_latency", "runner-x", "e"):
        spark.range(10).count()
    row = tables.read_points(spark, root, "prediction_latency", "runner-x", "e").first()
    assert 0 < row.latency < 60
