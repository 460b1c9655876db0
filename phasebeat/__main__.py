"""Command line: ``python -m phasebeat watch | live | traffic | report | compare``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasebeat.config import Settings
from phasebeat.operators import reports
from phasebeat.operators.anomaly import smape_accuracy
from phasebeat.operators.ticks import polled
from phasebeat.operators.traffic import process_tree
from phasebeat.plans.comparison import compare_files
from phasebeat.plans.online import Saved, watch
from phasebeat.schema import MAIN_PROCESSES, PROCESSES, TIMED_SAMPLES, WORKERS
from phasebeat.sources import samples as src
from phasebeat.sources import tables
from phasebeat.streaming import live
from phasebeat.workspace import store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phasebeat", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    w = commands.add_parser("watch", help="analyse recorded samples")
    w.add_argument("--samples", required=True, help="folder of JSON samples: cluster, worker, tick, resource_data, threaddump_data")
    w.add_argument("--timed", action="store_true", help="samples have a time ts, not a tick; the newest of each interval counts")
    w.add_argument("--workers", required=True, help="CSV of cluster, worker")
    w.add_argument("--out", required=True, help="folder for ticks, phases, models and scored ticks")
    w.add_argument("--algo", default=Settings.algo)
    w.add_argument("--variant", default=Settings.variant)
    w.add_argument("--replay", type=int, default=5, help="synthetic points added to each later training")
    w.add_argument("--stop_at_first", action="store_true", help="drop the ticks after the first alert of a cluster")
    w.add_argument("--empty_function", action="store_true", help="a silent worker counts as one with an empty function")
    w.add_argument("--missing_ends", action="store_true", help="a missing worker ends its cluster with an alert")
    w.add_argument("--phases", help="folder of saved phases: the analysis goes on from the version before and saves its own")
    w.add_argument("--version", type=int, default=1, help="version that is saved")
    w.add_argument("--points", help="folder for prediction and accuracy points")
    w.add_argument("--host", default="runner-recorded", help="host tag of the points")
    w.add_argument("-name", "--experiment_name", default="default-experiment")
    w.add_argument("--interval", type=float, default=2.0, help="seconds between two ticks")
    w.add_argument("--stats", help="folder for statistics lines, a folder per cluster")
    w.add_argument("--workload", help="name of the workload in the statistics")
    add_limits(w)

    v = commands.add_parser("live", help="analyse samples as they arrive and publish metric points")
    v.add_argument("--samples", required=True, help="folder where JSON samples land: cluster, worker, ts, resource_data, threaddump_data")
    v.add_argument("--workers", required=True, help="CSV of cluster, worker")
    v.add_argument("--points", required=True, help="folder for the points")
    v.add_argument("--checkpoint", required=True, help="folder for the state of the stream")
    v.add_argument("--host", required=True, help="host tag of the points")
    v.add_argument("-name", "--experiment_name", default="default-experiment")
    v.add_argument("--algo", default=Settings.algo)
    v.add_argument("--interval", default="2 seconds", help="time between two snapshots")
    v.add_argument("--delay", default="2 seconds", help="how late a sample may arrive")
    v.add_argument("--files", default="1000", help="most files to take up at once")
    v.add_argument("--available", action="store_true", help="stop when all samples there are analysed")
    v.add_argument("--go_on", action="store_true", help="a cluster does not end at its first alert")
    v.add_argument("--replay", type=int, default=5, help="synthetic points added to each later training")
    v.add_argument("--empty_function", action="store_true", help="a silent worker counts as one with an empty function")
    v.add_argument("--missing_ends", action="store_true", help="a missing worker ends its cluster with an alert")
    v.add_argument("--keep_confidence", action="store_true", help="go on with the confidence of the start before")
    v.add_argument("--late", choices=("fail", "count"), default="fail", help="what happens if samples come later than the delay")
    v.add_argument("--partitions", type=int, help="partitions of the state, fixed by the first start")
    add_limits(v)

    t = commands.add_parser("traffic", help="publish the resource use of watched processes from their traffic logs")
    t.add_argument("--logs", required=True, help="folder where pieces of logs land, a folder host=NAME per host")
    t.add_argument("--processes", required=True, help="CSV of host, pid, ppid, cpu, mem")
    t.add_argument("--main", required=True, help="CSV of host, pid: the main process of each host")
    t.add_argument("--points", required=True, help="folder for the points")
    t.add_argument("--checkpoint", required=True, help="folder for the state of the stream")
    t.add_argument("-name", "--experiment_name", default="default-experiment")
    t.add_argument("--exact", action="store_true", help="a line belongs to the process in its pid field only")
    t.add_argument("--interval", default="2 seconds", help="time between two looks at the folder")
    t.add_argument("--available", action="store_true", help="stop when all logs there are read")

    r = commands.add_parser("report", help="report on stored metric points")
    r.add_argument("--points", required=True, help="folder with one folder per measurement")
    r.add_argument("-uid", "--uniqueid", help="host tag without its prefix; all hosts if left out")
    r.add_argument("-name", "--experiment_name", help="experiment tag; all experiments if left out")
    r.add_argument("-op", "--operation", choices=("max", "min", "avg", "freq", "latency"))
    r.add_argument("-m", "--metric")
    r.add_argument("--all", action="store_true", help="full report")
    r.add_argument("--zone", default="UTC", help="time zone of printed window starts")
    r.add_argument("--out", help="folder for the report as CSV; printed if left out")

    c = commands.add_parser("compare", help="compare algorithms over workloads")
    c.add_argument("--stats", required=True, help="stats to compare, separated by commas")
    c.add_argument("--stat_files", required=True, help="statistics files, separated by commas")
    c.add_argument("--algos", required=True, help="algorithm of each file, separated by commas")
    c.add_argument("--save_path", help="folder for one CSV per stat; printed if left out")
    return top


LIMITS = ("threshold", "stride", "mape_limit", "cpu_floor", "confidence_limit")


def add_limits(p: argparse.ArgumentParser) -> None:
    p.add_argument("--threshold", type=float, default=Settings.threshold, help="similarity below which the phase has changed")
    p.add_argument("--stride", type=int, default=Settings.stride, help="snapshots per evaluation")
    p.add_argument("--mape_limit", type=float, default=Settings.mape_limit)
    p.add_argument("--cpu_floor", type=float, default=Settings.cpu_floor)
    p.add_argument("--confidence_limit", type=int, default=Settings.confidence_limit)


def settings_of(a: argparse.Namespace, **more) -> Settings:
    return Settings(algo=a.algo, replay=a.replay if a.algo == "lasso" else 0, **{n: getattr(a, n) for n in LIMITS}, **more)


def run_watch(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = settings_of(a, variant=a.variant)
    samples = polled(src.read_samples(spark, a.samples, TIMED_SAMPLES), a.interval) if a.timed else src.read_samples(spark, a.samples)
    expected = spark.read.schema(WORKERS).csv(a.workers)
    before = Saved.load(spark, a.phases, a.version - 1) if a.phases else None
    found = watch(samples, expected, settings, a.stop_at_first, a.empty_function, before=before, missing_ends=a.missing_ends)
    found.scored.write.parquet(f"{a.out}/scored")
    found.ticks.write.parquet(f"{a.out}/ticks")
    found.phases.write.parquet(f"{a.out}/phases")
    if found.models is not None:
        found.models.write.parquet(f"{a.out}/models")
    if a.phases:
        found.state().save(a.phases, a.version)
    scored = spark.read.parquet(f"{a.out}/scored")
    alerted = scored.groupBy("cluster").agg(F.max("alert").alias("alert"))
    scored = scored.where("tick_no IS NOT NULL")
    if a.points:
        time = F.timestamp_seconds(F.col("tick") * a.interval)
        tagged = scored.withColumns({"time": time, "host": F.lit(a.host), "experiment_name": F.lit(a.experiment_name)})
        suffix = settings.measurement_suffix
        tables.write_points(tables.prediction_points(tagged), a.points, reports.PREDICTION_POINTS + suffix)
        tables.write_points(tables.accuracy_points(tagged), a.points, reports.ACCURACY_POINTS + suffix)
    if a.stats:
        accuracy = smape_accuracy(scored, ["cluster"])
        lines = tables.accuracy_lines(accuracy.join(alerted, "cluster"), ["cluster"], a.variant, F.col("alert"), a.workload)
        tables.append_lines(lines, a.stats, ["cluster"])


def run_live(spark: SparkSession, a: argparse.Namespace) -> None:
    samples = src.stream_samples(spark, a.samples, maxFilesPerTrigger=a.files)
    workers = spark.read.schema(WORKERS).csv(a.workers)
    ticks = live.tick_stream(samples, workers, a.interval, a.delay)
    trigger = {"availableNow": True} if a.available else {"processingTime": a.interval}
    found = live.watch_stream(ticks, settings_of(a), a.empty_function, a.keep_confidence, not a.go_on, a.missing_ends)
    # When every cluster has ended there is nothing left to watch.
    clusters = None if a.go_on else workers.select("cluster").distinct().count()
    done = live.publish(found, a.points, a.checkpoint, a.host, a.experiment_name, clusters, a.partitions, a.late, **trigger)
    if done.alerted:
        print("Anomaly Detected")
    if done.late:
        print(f"{done.late} rows came too late and are in no result")


def run_traffic(spark: SparkSession, a: argparse.Namespace) -> None:
    processes = spark.read.schema(PROCESSES).csv(a.processes)
    main = spark.read.schema(MAIN_PROCESSES).csv(a.main).withColumn("main", F.lit(True))
    rows = processes.join(main, ["host", "pid"], "left")
    watched = store(process_tree(rows, F.coalesce("main", F.lit(False))), "watched")
    log = F.regexp_extract("path", "host=([^/]+)/", 1).alias("log")
    chunks = live.chunk_stream(src.stream_logs(spark, a.logs).select(log, "written", "value"))
    trigger = {"availableNow": True} if a.available else {"processingTime": a.interval}
    live.publish_resources(chunks, watched, a.points, a.checkpoint, a.experiment_name, a.exact, **trigger)


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    host = None if a.uniqueid is None else reports.host_of(a.uniqueid)

    def points(measurement: str) -> DataFrame:
        return tables.read_points(spark, a.points, measurement, host, a.experiment_name)

    if a.all:
        names = (reports.RESOURCE_POINTS, reports.PREDICTION_POINTS, reports.ACCURACY_POINTS, *reports.LATENCY_POINTS)
        there = {n: points(n) for n in names if tables.exists(spark, f"{a.points}/{n}")}
        rows = tables.report_lines(reports.full_report(there), a.zone)
        show(rows, a.out, ["section", "metric", "window_start"])
        return
    if not a.operation or (not a.metric and a.operation != "freq"):
        raise SystemExit("give --all, or --operation with --metric")
    if a.operation == "freq":
        rows = reports.extremes(points(reports.PREDICTION_POINTS), reports.COUNTED_METRICS, reports.TAGS)
        rows = rows.select(*reports.TAGS, "metric", "count")
    elif a.operation == "latency":
        rows = reports.report(points(a.metric), a.metric, "latency")
    else:
        rows = reports.report(points(reports.RESOURCE_POINTS), a.metric, a.operation)
    show(rows, a.out, ["metric", *(["window_start"] if "window_start" in rows.columns else [])])


def show(rows: DataFrame, out: str | None, order: list[str]) -> None:
    ordered = rows.orderBy(*[F.col(c).asc_nulls_last() for c in [*reports.TAGS, *order]])
    if out:
        ordered.write.option("header", True).csv(out)
    else:
        print_rows(ordered)


def print_rows(ordered: DataFrame) -> None:
    """All rows, a partition at a time."""
    print("\t".join(ordered.columns))
    for row in ordered.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def run_compare(spark: SparkSession, a: argparse.Namespace) -> None:
    algos, files = a.algos.split(","), a.stat_files.split(",")
    if len(algos) != len(files):
        raise SystemExit("give one algorithm per statistics file")
    for stat, table in compare_files(spark, dict(zip(algos, files)), tuple(a.stats.split(","))).items():
        if a.save_path:
            tables.write_comparison(table.orderBy("workload"), a.save_path, stat, algos)
        else:
            print(stat)
            print_rows(table.orderBy("workload"))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"phasebeat {args.command}").getOrCreate()
    commands = {"watch": run_watch, "live": run_live, "traffic": run_traffic, "report": run_report, "compare": run_compare}
    commands[args.command](spark, args)


if __name__ == "__main__":
    main()
