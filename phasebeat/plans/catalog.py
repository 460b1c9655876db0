"""The registered queries: each operator of the library over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasebeat.config import RESOURCES, Settings
from phasebeat.functions import text
from phasebeat.operators import anomaly, compare, dumps, models, phases, reports, runs, ticks, traffic
from phasebeat.operators.ordered import whole_part
from phasebeat.plans import datasets as data
from phasebeat.plans.online import Saved, visited, visited_ticks, watch, watch_ticks
from phasebeat.schema import PROCESS, SAMPLES, TIMED_SAMPLES, WORKER_LOG
from phasebeat.sources import samples as src
from phasebeat.sources import tables
from phasebeat.streaming import live
from phasebeat.workspace import new_dir, store

# Segments far shorter than the default, so that small tables take the steps of large ones.
CUT = 512
SHORT = Settings(segment_rows=CUT, chain_rows=256)
# Without replay unless a query is about it.
PAIRS = replace(SHORT, replay=0)
DENSE = replace(SHORT, stride=1, replay=0)
TAGS = ["host", "experiment_name"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Six places.  Rounding to nine first keeps the order of adding from deciding ties."""
    return F.round(F.round(F.col(c) if isinstance(c, str) else c, 9), 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


# --- reports -----------------------------------------------------------------------------


@query
def report_window_mean(spark, sf):
    windows = reports.window_means(data.points(spark, sf), ("value",), [*TAGS, "measurement"])
    return windows.select(*TAGS, "measurement", stamp("window_start").alias("window_start"), r6("mean").alias("mean"))


@query
def report_mean_of_means(spark, sf):
    by = [*TAGS, "measurement"]
    windows = reports.window_means(data.points(spark, sf), ("value", "k"), by, "1 hour")
    return rounded(reports.mean_of_means(windows, by), "mean")


@query
def report_max_min_count(spark, sf):
    return reports.extremes(data.points(spark, sf), ("value", "k"), [*TAGS, "measurement"])


@query
def report_full(spark, sf):
    rows = reports.full_report(data.report_points(spark, sf), window="1 hour")
    return rounded(rows.withColumn("window_start", stamp("window_start")), "value")


@query
def report_call(spark, sf):
    """Each operation of the report, for every host and experiment."""
    points = data.points(spark, sf).withColumn("latency", F.col("value") / 1000.0)
    parts = []
    for op, metric in (("max", "value"), ("min", "value"), ("freq", "k"), ("avg", "k"), ("latency", "step_latency")):
        rows = reports.report(points, metric, op, TAGS, "6 hours").withColumn("op", F.lit(op))
        if "window_start" not in rows.columns:
            rows = rows.withColumn("window_start", F.lit(None).cast("timestamp_ntz"))
        parts.append(rows.select(*TAGS, "op", "metric", stamp("window_start").alias("window_start"), r6("value").alias("value")))
    return reduce(DataFrame.unionByName, parts)


@query
def step_latency(spark, sf):
    points = reports.step_latencies(data.steps(spark, sf))
    windows = reports.window_means(points, ("latency",), [*TAGS, "measurement"], "1 hour")
    mean = F.round("mean", 9).alias("mean")
    return windows.select(*TAGS, "measurement", stamp("window_start").alias("window_start"), mean)


@query
def local_time(spark, sf):
    """Window starts as UTC text, back to a time, and as wall clock of a zone."""
    windows = reports.window_means(data.points(spark, sf), ("value",), ["measurement"], "1 hour")
    utc = F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = windows.withColumn("utc", utc)
    return rows.select(
        "measurement", "utc", stamp(reports.local_time(reports.utc_text_to_time(F.col("utc")), "America/Toronto")).alias("local")
    )


@query
def formatted_output(spark, sf):
    """Values as the printed forms have them, with two, three and five places."""
    rows = data.points(spark, sf).select(
        "event_id", F.concat(F.lit("runner-"), F.substring_index("host", "-", -1)).alias("host"),
        *[text.places(F.col("value") / 8, n).alias(f"places{n}") for n in (2, 3, 5)],
    )
    return rows


# --- samples, snapshots, phases ---------------------------------------------------------


def recorded(spark: SparkSession, sf: str, per_tick: int = data.TICK_EVENTS) -> tuple[DataFrame, DataFrame]:
    """Samples as a stored table, and the expected workers."""
    return store(data.samples(spark, sf, per_tick=per_tick), "samples"), data.workers(spark, sf)


def raw(spark: SparkSession, sf: str, per_tick: int = data.TICK_EVENTS) -> tuple[DataFrame, DataFrame]:
    """Samples for steps that read them once, and the expected workers."""
    return data.samples(spark, sf, per_tick=per_tick), data.workers(spark, sf)


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return store(ticks.cluster_ticks(*raw(spark, sf), segment_rows=CUT), "ticks")


@query
def parse_resource_lines(spark, sf):
    return ticks.parse_resources(data.samples(spark, sf, with_functions=False))


@query
def locf_resources(spark, sf):
    samples, expected = recorded(spark, sf)
    filled = ticks.fill_forward(ticks.parse_resources(ticks.with_silent_workers(samples, expected)), CUT)
    return filled.select("cluster", "worker", "tick", *RESOURCES)


@query
def cluster_mean_fixed_divisor(spark, sf):
    samples, expected = recorded(spark, sf)
    filled = ticks.fill_forward(ticks.parse_resources(samples), CUT)
    return rounded(ticks.cluster_means(filled, expected), *RESOURCES)


@query
def missing_workers(spark, sf):
    return ticks.missing_workers(data.samples(spark, sf, with_functions=False), data.workers(spark, sf))


@query
def function_union(spark, sf):
    sets = ticks.function_union(data.samples(spark, sf), with_counts=True)
    return sets.select("cluster", "tick", joined("funcs"), joined("counted"))


@query
def latest_sample(spark, sf):
    return ticks.latest_samples(data.samples(spark, sf, with_functions=False), "tick")


@query
def triplets(spark, sf):
    found = ticks.triplets(snapshots(spark, sf), Settings(), CUT)
    values = [f"{r}{s}" for r in RESOURCES for s in ("_prev2", "_prev1", "")]
    return rounded(
        found.select("cluster", "tick", "tick_no", *values, joined("funcs_prev1"), joined("funcs")), *values
    )


def named(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    rows = store(ticks.cluster_ticks(*raw(spark, sf), settings, CUT), "ticks")
    return phases.named(rows, settings, CUT)[0]


@query
def stack_similarity(spark, sf):
    rows = named(spark, sf, DENSE)
    return rounded(rows.select("cluster", "tick_no", "similarity", "phase_changed"), "similarity")


@query
def phase_keys(spark, sf):
    return named(spark, sf, DENSE).select("cluster", "tick_no", "phase", "phase_id")


def numbered(spark: SparkSession, sf: str, settings: Settings) -> tuple[DataFrame, int | None]:
    _, _, rows, cut = visited(*raw(spark, sf), settings)
    return rows, cut


VISIT = ["cluster", "tick", "tick_no", "phase_id", "idle", "prior", "seen", "version"]


@query
def phase_visits(spark, sf):
    return numbered(spark, sf, PAIRS)[0].select(VISIT)


@query
def phase_visits_v1(spark, sf):
    """Visits of the first variant: malformed snapshots break pairs, training takes a visit of its own."""
    return numbered(spark, sf, replace(SHORT, variant="v1"))[0].select(VISIT)


@query
def idle_and_first_tick_guards(spark, sf):
    """Profiles that are stored, in both variants, and which of them is the first of its phase."""
    parts = []
    # The samples are read once for both.
    found = ticks.measured(*raw(spark, sf), with_counts=True)
    for settings in (DENSE, replace(SHORT, variant="v1", stride=1)):
        rows = visited_ticks(ticks.measured_ticks(found, settings, CUT), settings)
        stored = rows.where("counts").select("cluster", "tick_no", "phase_id", (F.col("prior") == 0).alias("first"))
        parts.append(stored.withColumn("variant", F.lit(settings.variant)))
    return parts[0].unionByName(parts[1])


# --- models and predictions -----------------------------------------------------------------


@query
def predict_simple(spark, sf):
    settings = replace(SHORT, algo="simple")
    rows, _ = numbered(spark, sf, settings)
    return predicted(models.predict(rows, models.train(rows, settings), settings))


def predicted(rows: DataFrame) -> DataFrame:
    names = [f"predicted_{r}" for r in RESOURCES]
    return rounded(rows.select("cluster", "tick_no", "phase_id", "seen", "version", *names), *names)


@query
def profile_batches(spark, sf):
    rows, _ = numbered(spark, sf, DENSE)
    stats = models.batch_statistics(models.batches(rows, DENSE), DENSE)
    return rounded(stats, *[c for c in stats.columns if c.startswith("sum_")])


def fitted(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    rows, _ = numbered(spark, sf, settings)
    by_resource = models.models_by_resource(models.train(rows, settings), settings)
    return rounded(by_resource, "w_prev2", "w_prev1", "intercept")


@query
def lasso_models(spark, sf):
    return fitted(spark, sf, DENSE)


@query
def lasso_replay(spark, sf):
    return fitted(spark, sf, replace(SHORT, stride=1, replay=5))


def forecast(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    rows, _ = numbered(spark, sf, settings)
    return models.predict(rows, models.train(rows, settings), settings)


@query
def lasso_predict(spark, sf):
    return predicted(forecast(spark, sf, DENSE))


AGG = replace(DENSE, variant="v1", algo="agg")


@query
def agg_models(spark, sf):
    rows, _ = numbered(spark, sf, AGG)
    return rounded(models.train(rows, AGG), *[f"{r}_mean" for r in RESOURCES])


@query
def agg_predict(spark, sf):
    return predicted(forecast(spark, sf, AGG))


@query
def algo_choice(spark, sf):
    """The same ticks predicted by each algorithm of the first variant."""
    rows, _ = numbered(spark, sf, AGG)
    parts = []
    for algo in ("simple", "lasso", "agg"):
        settings = replace(DENSE, variant="v1", algo=algo)
        made = predicted(models.predict(rows, models.train(rows, settings), settings))
        parts.append(made.withColumn("algo", F.lit(algo)))
    return reduce(DataFrame.unionByName, parts)


# --- accuracy and anomalies -------------------------------------------------------------------


@query
def smape_accuracy(spark, sf):
    return rounded(anomaly.smape_accuracy(forecast(spark, sf, DENSE), ["cluster"]), *[f"acc_{r}" for r in RESOURCES])


def scores(spark: SparkSession, sf: str, settings: Settings = DENSE, **kwargs) -> DataFrame:
    return watch(*raw(spark, sf), settings, **kwargs).scored


@query
def running_accuracy(spark, sf):
    rows = scores(spark, sf).select("cluster", "tick_no", "acc_cpu", "acc_mem")
    return rounded(rows, "acc_cpu", "acc_mem")


@query
def anomaly_steps(spark, sf):
    rows = anomaly.anomaly_steps(forecast(spark, sf, DENSE), DENSE)
    return rounded(rows.select("cluster", "tick_no", "idle", "seen", "mape", "step"), "mape")


@query
def anomaly_confidence(spark, sf):
    return scores(spark, sf).select("cluster", "tick_no", "step", "confidence")


@query
def anomaly_alerts(spark, sf):
    rows = anomaly.alerts(scores(spark, sf, PAIRS))
    return rows.select("cluster", "tick", "tick_no", "phase_id", "confidence")


@query
def anomaly_first_alert(spark, sf):
    """The run of each cluster up to its first alert."""
    rows = scores(spark, sf, PAIRS, stop_at_first=True)
    return rows.select("cluster", "tick_no", "confidence", "alert")


@query
def watch_minutes(spark, sf):
    """The whole analysis with a tick for every event."""
    rows = watch(*raw(spark, sf, 1), PAIRS).scored
    names = ("cpu", "mem", "predicted_cpu", "predicted_mem", "acc_cpu", "acc_mem")
    keep = ("cluster", "tick", "tick_no", "phase_id", "seen", "version", "confidence", "alert")
    return rounded(rows.select(*keep, *names), *names)


# So many events a tick that large clusters have all their workers in most ticks.
MISSING_EVENTS = 100


@query
def missing_worker_ends(spark, sf):
    """Every cluster up to the first tick in which one of its workers is missing, which is an alert."""
    rows = watch(*recorded(spark, sf, MISSING_EVENTS), DENSE, missing_ends=True).scored
    return rows.select("cluster", "tick", "tick_no", "confidence", "alert")


# --- runs, processes, traffic -------------------------------------------------------------------


@query
def process_samples(spark, sf):
    rows = data.process_samples(spark, sf)
    pid = F.when(text.is_executor(F.col("name")), F.col("pid"))
    return rows.select("cluster", "worker", "tick", pid.alias("pid"), text.live_resource_line(pid, F.col("line")).alias("line"))


@query
def workload_change_log(spark, sf):
    rows = store(data.process_samples(spark, sf), "process_samples")
    return runs.workload_changes(rows, CUT).select("cluster", "worker", "tick", "pid")


@query
def run_sample_no(spark, sf):
    rows = store(data.process_samples(spark, sf), "process_samples")
    return runs.sample_numbers(rows, CUT).select("cluster", "worker", "tick", "pid", "sample_no")


@query
def workload_log_scan(spark, sf):
    """The change log of all workers written as lines and read back."""
    rows = store(data.process_samples(spark, sf), "process_samples")
    log = runs.workload_changes(rows, CUT)
    path = new_dir(spark, "workloads")
    log.select("cluster", "worker", (F.col("tick") * 3600).alias("ts"), "pid").write.csv(path)
    return src.read_workload_log(spark, path, WORKER_LOG)


@query
def resource_history(spark, sf):
    """Numbered samples appended to the history of their process and read back."""
    rows = store(data.process_samples(spark, sf), "process_samples")
    found = runs.sample_numbers(rows, CUT).where(F.col("pid").isNotNull())
    dead = F.col("line").contains(text.HEADER_WORD)
    lines = found.select(
        *PROCESS,
        F.when(dead, F.lit(0)).otherwise(F.col("sample_no")).alias("count"),
        text.live_resource_line(F.col("pid"), F.col("line")).alias("resource_data"),
    )
    path = new_dir(spark, "history")
    tables.append_history(lines, path)
    return src.read_resource_history(spark, path)


@query
def process_tree(spark, sf):
    found = traffic.process_tree(data.processes(spark, sf), data.main_process())
    return found.select("host", "pid", "ppid", "is_main")


@query
def traffic_log_scan(spark, sf):
    """Traffic logs written as a text file per host, read by line and cut into chunks."""
    path = new_dir(spark, "traffic")
    tables.append_lines(data.traffic_lines(spark, sf), path, ["host"])
    lines = src.read_lines(spark, path)
    lines = lines.select(F.regexp_extract("path", "host=([^/]+)/", 1).alias("host"), "line_no", "line")
    chunks = traffic.chunked(lines, ["host"], CUT)
    others = F.count(F.when(F.col("line") != traffic.REFRESH, 1))
    return chunks.groupBy("host", "chunk").agg(others.alias("lines"))


def traffic_usage(spark: SparkSession, sf: str, exact: bool) -> DataFrame:
    watched = traffic.process_tree(data.processes(spark, sf), data.main_process())
    lines = data.traffic_lines(spark, sf)
    chunks = traffic.chunked(lines, ["host"], CUT)
    found = traffic.usage_by_chunk(chunks, watched, ["host", "chunk"], exact=exact)
    return rounded(found, "upload", "download", "cpu", "mem")


@query
def traffic_chunks(spark, sf):
    return traffic_usage(spark, sf, exact=False)


@query
def traffic_chunks_exact(spark, sf):
    return traffic_usage(spark, sf, exact=True)


# --- dumps and text -----------------------------------------------------------------------


def spark_stacks(texts: DataFrame, key: str) -> DataFrame:
    """Distinct stacks of each dump that mention Spark."""
    stacks = texts.select(key, F.explode(text.dump_stacks(text.scrub_addresses(F.col("value")))).alias("s"))
    return stacks.select(key, "s.stack", "s.threads").where(text.mentions_spark(F.col("stack"))).distinct()


@query
def dump_stacks(spark, sf):
    rows = spark_stacks(data.dumps(spark, sf), "dump_no")
    return rows.withColumn("line", text.tagged_stack(F.col("stack"), F.col("threads")))


@query
def dump_stack_counts(spark, sf):
    return spark_stacks(data.dumps(spark, sf), "dump_no").groupBy("dump_no").agg(F.count("*").alias("stacks"))


@query
def stack_text(spark, sf):
    """Stacks written as text lines for the collector and read back."""
    rows = spark_stacks(data.dumps(spark, sf), "dump_no")
    path = new_dir(spark, "stacks")
    lines = text.tagged_stack(F.col("stack"), F.coalesce("threads", F.lit("-1")))
    rows.select(lines.alias("value")).write.text(path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("times"))


def stacks_in_files(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stacks that mention Spark, of dump files of any size read by line."""
    lines = src.read_lines(spark, path)
    number = F.regexp_extract("path", "dump_no=([0-9]+)/", 1).cast("long").alias("dump_no")
    # A dump may be written as several files.
    rows = lines.select(number, "path", "line_no", text.scrub_addresses(F.col("line")).alias("line"))
    stacks = dumps.stacks_of_lines(rows, ["dump_no", "path"], CUT)
    return stacks.select("dump_no", "stack", "threads").where(text.mentions_spark(F.col("stack"))).distinct()


@query
def dump_files(spark, sf):
    """Dumps written as one text file each, longer than those above, and read by line."""
    path = new_dir(spark, "dumps")
    # The writer ends the text with the newline that is cut off here.
    rows = data.dumps(spark, sf, 1000).select("dump_no", F.expr("left(value, length(value) - 1)").alias("value"))
    rows.write.partitionBy("dump_no").text(path)
    return stacks_in_files(spark, path)


@query
def dump_large_file(spark, sf):
    """The same with one dump that holds a third of all stacks."""
    path = new_dir(spark, "dumps")
    tables.append_lines(data.dump_lines(spark, sf), path, ["dump_no"])
    return stacks_in_files(spark, path)


@query
def doc_blocks(spark, sf):
    """Document lines cut into blocks; a line that starts with E or T starts one."""
    docs = data.table(spark, sf, "documents").select("doc_id", "text")
    blocks = text.with_blocks(docs, "text", lambda line: line.startswith("E") | line.startswith("T"))
    rows = blocks.select("doc_id", F.posexplode("blocks").alias("block_no", "lines"))
    return rows.select(
        "doc_id", "block_no", F.size("lines").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("digest")
    )


# --- comparison -------------------------------------------------------------------------------

STATS = ("CPU", "MEM")
ALGOS = ["F", "O", "P"]


def repeats(spark: SparkSession, sf: str) -> DataFrame:
    lines = data.stats_lines(spark, sf)
    return compare.parse_stats(lines, STATS, (data.FAILED_RUN,), CUT)


@query
def stats_file_parse(spark, sf):
    return rounded(repeats(spark, sf), *STATS)


@query
def stats_file_scan(spark, sf):
    """Statistics lines written as files of a thousand orders, numbered when read, and parsed per file."""
    path = new_dir(spark, "stats")
    keys = ["algo", "part"]
    lines = data.stats_lines(spark, sf).withColumn("part", whole_part("line_no", 5000))
    tables.append_lines(lines, path, keys)
    found = [F.regexp_extract("path", f"{k}=([^/]+)/", 1).alias(k) for k in keys]
    lines = src.read_lines(spark, path).select(*found, "line_no", "line")
    repeats_ = compare.parse_stats(lines, STATS, (data.FAILED_RUN,), CUT, tuple(keys))
    return rounded(repeats_.withColumn("part", F.col("part").cast("long")), *STATS)


@query
def compare_workloads(spark, sf):
    means = compare.workload_means(repeats(spark, sf), STATS)
    return rounded(compare.compare(means, "CPU", ALGOS), *ALGOS)


@query
def equal_repeats(spark, sf):
    return compare.unequal_repeats(repeats(spark, sf), compare.named_workloads(data.stats_lines(spark, sf)))


@query
def compare_csv(spark, sf):
    means = store(compare.workload_means(repeats(spark, sf), STATS), "means")
    path = new_dir(spark, "comparison")
    parts = []
    for stat in STATS:
        table = rounded(compare.compare(means, stat, ALGOS), *ALGOS)
        target = tables.write_comparison(table, path, stat, ALGOS)
        schema = "workload string, F double, O double, P double"
        parts.append(spark.read.schema(schema).csv(target, header=True).withColumn("stat", F.lit(stat)))
    return parts[0].unionByName(parts[1])


# --- writing and reading back -----------------------------------------------------------------


def run_points(spark: SparkSession, sf: str) -> DataFrame:
    """Scored ticks with the tags of a point; the time is that of the tick."""
    time = F.expr(f"timestampadd(SECOND, tick, TIMESTAMP_NTZ '{data.ORIGIN} 00:00:00')")
    return scores(spark, sf).withColumns(
        {"time": time, "host": F.concat(F.lit("runner-"), "cluster"), "experiment_name": F.lit("hourly")}
    )


@query
def predictions_points(spark, sf):
    root = new_dir(spark, "points")
    tables.write_points(tables.prediction_points(run_points(spark, sf)), root, "predictions")
    rows = tables.read_points(spark, root, "predictions", experiment="hourly")
    fields = ("actual_cpu", "actual_mem", "predicted_cpu", "predicted_mem")
    return rounded(rows.select(stamp("time").alias("time"), *TAGS, *fields), *fields)


@query
def accuracy_points(spark, sf):
    """Accuracy of the first variant: the first tick has none."""
    settings = replace(SHORT, variant="v1", algo="simple", stride=1)
    time = F.expr(f"timestampadd(SECOND, tick, TIMESTAMP_NTZ '{data.ORIGIN} 00:00:00')")
    rows = scores(spark, sf, settings).withColumns(
        {"time": time, "host": F.concat(F.lit("runner-"), "cluster"), "experiment_name": F.lit("hourly")}
    )
    root, name = new_dir(spark, "points"), "accuracy" + settings.measurement_suffix
    tables.write_points(tables.accuracy_points(rows), root, name)
    rows = tables.read_points(spark, root, name)
    return rounded(rows.select(stamp("time").alias("time"), *TAGS, "acc_cpu", "acc_mem"), "acc_cpu", "acc_mem")


@query
def metric_points(spark, sf):
    """Any measurement with a map of fields, written and read back by measurement."""
    root = new_dir(spark, "points")
    points = data.points(spark, sf).drop("event_id")
    tables.write_generic_points(tables.as_generic_points(points), root)
    rows = spark.read.parquet(root)
    return rows.groupBy("measurement", *TAGS).agg(
        F.count("*").alias("n"),
        F.max(F.col("fields")["value"]).alias("max_value"),
        r6(F.sum(F.col("fields")["k"])).alias("sum_k"),
    )


@query
def phase_db_roundtrip(spark, sf):
    """Phase tables saved and loaded; later ticks against the phases known from the first half."""
    rows, _ = numbered(spark, sf, DENSE)
    root = new_dir(spark, "phases")
    half = data.middle(rows)
    early = rows.where(F.col("tick") < half)
    tables.save_phases(
        root, 1,
        profiles=models.pending_profiles(early, DENSE),
        models=models.models_by_resource(models.train(early, DENSE), DENSE),
        phases=early.where("counts").select("cluster", "phase_id").distinct(),
    )
    saved = {n: tables.load_phases(spark, root, 1, n) for n in ("profiles", "models", "phases")}
    late = rows.where((F.col("tick") >= half) & ~F.col("idle"))
    count = F.count("*").alias("n")
    parts = [
        saved["profiles"].groupBy("cluster").agg(count).withColumn("part", F.lit("pending")),
        saved["models"].groupBy("cluster").agg(count).withColumn("part", F.lit("models")),
        phases.known_phases(late, saved["phases"]).groupBy("cluster").agg(count).withColumn("part", F.lit("known")),
        phases.new_phases(late, saved["phases"]).groupBy("cluster").agg(count).withColumn("part", F.lit("new")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def resumed_watch(spark, sf):
    """A run that stops halfway, saves its phases, and a second one that goes on from them."""
    samples, expected = raw(spark, sf)
    rows = store(ticks.cluster_ticks(samples, expected, DENSE, CUT), "ticks")
    root = new_dir(spark, "phases")
    half = data.middle(rows)
    watch_ticks(rows.where(F.col("tick") < half), DENSE).state().save(root, 1)
    found = watch_ticks(rows.where(F.col("tick") >= half), DENSE, before=Saved.load(spark, root, 1)).scored
    values = ("predicted_cpu", "predicted_mem", "mape")
    return rounded(found.select("cluster", "tick", "phase_id", "seen", "version", "step", *values), *values)


@query
def summary_append(spark, sf):
    """Final accuracy blocks appended to a statistics file per cluster, read back by line."""
    accuracy = anomaly.smape_accuracy(forecast(spark, sf, DENSE), ["cluster"])
    path = new_dir(spark, "stats")
    tables.append_lines(tables.accuracy_lines(accuracy, ["cluster"]), path, ["cluster"])
    lines = src.read_lines(spark, path).withColumn("cluster", F.regexp_extract("path", "cluster=([^/]+)/", 1))
    return lines.select("cluster", "line_no", "line")


@query
def summary_append_v1(spark, sf):
    """Blocks of the first variant, with a line for clusters that had an alert."""
    rows = store(scores(spark, sf, replace(DENSE, variant="v1", algo="simple")), "scored")
    alerted = rows.groupBy("cluster").agg(F.max("alert").alias("alert"))
    accuracy = anomaly.smape_accuracy(rows, ["cluster"]).join(alerted, "cluster")
    path = new_dir(spark, "stats")
    tables.append_lines(tables.accuracy_lines(accuracy, ["cluster"], "v1", F.col("alert")), path, ["cluster"])
    lines = src.read_lines(spark, path).withColumn("cluster", F.regexp_extract("path", "cluster=([^/]+)/", 1))
    return lines.select("cluster", "line_no", "line")


@query
def report_files(spark, sf):
    path = new_dir(spark, "report")
    rows = reports.full_report(data.report_points(spark, sf), window="6 hours")
    tables.write_report(rounded(rows.withColumn("window_start", stamp("window_start")), "value"), path)
    schema = "host string, experiment_name string, section string, metric string, window_start string, value double"
    return spark.read.schema(schema).csv(path, header=True)


@query
def report_lines(spark, sf):
    """The full report as printed, window starts in a local zone."""
    rows = reports.full_report(data.report_points(spark, sf), window="6 hours")
    # Printed places are fewer than the noise of adding in another order, but a tie must not depend on it.
    rows = tables.report_lines(rounded(rows, "value"), "America/Toronto")
    return rows.select(*TAGS, "section", "metric", stamp("window_start").alias("window_start"), "line")


@query
def paired_accuracy(spark, sf):
    """Accuracy of actual and predicted values that are stored apart."""
    rows = forecast(spark, sf, replace(SHORT, algo="simple"))
    keys = ["cluster", "tick_no"]
    actual = store(rows.select(*keys, *RESOURCES), "actual")
    made = store(rows.select(*keys, *[f"predicted_{r}" for r in RESOURCES]), "made")
    found = anomaly.smape_accuracy(tables.paired(actual, made, keys), ["cluster"])
    return rounded(found, *[f"acc_{r}" for r in RESOURCES])


@query
def samples_json_roundtrip(spark, sf):
    """Samples written as JSON and read back, silent workers filled in with one empty function."""
    path = new_dir(spark, "samples")
    data.samples(spark, sf).write.json(path)
    rows = ticks.with_silent_workers(src.read_samples(spark, path, SAMPLES), data.workers(spark, sf), empty_function=True)
    return rows.select(
        "cluster", "worker", "tick", "resource_data", F.array_join("threaddump_data", "|").alias("threaddump_data")
    )


# --- streams -----------------------------------------------------------------------------------


def timed_samples(samples: DataFrame) -> DataFrame:
    ts = F.expr(f"timestampadd(SECOND, tick, TIMESTAMP '{data.ORIGIN} 00:00:00')")
    return samples.select("cluster", "worker", ts.alias("ts"), "resource_data", "threaddump_data")


@query
def polled_samples(spark, sf):
    """The newest sample of each worker in every three seconds, as a poll sees them."""
    rows = ticks.polled(timed_samples(data.samples(spark, sf, with_functions=True)), 3.0)
    return rows.select("cluster", "worker", "tick", "resource_data")


@query
def stream_window_mean(spark, sf):
    """Five-minute means of a stream of points, to the end of the input."""
    source, path, check = (new_dir(spark, n) for n in ("points", "means", "check"))
    points = data.points(spark, sf).withColumn("time", F.col("time").cast("timestamp")).drop("event_id")
    points.write.parquet(source)
    stream = spark.readStream.schema(points.schema).parquet(source)
    means = live.window_mean_stream(stream, "value", ["measurement", "host"])
    live.run_available(means, path, check)
    live.end_marker(points, "time", "10 minutes").write.mode("append").parquet(source)
    live.run_available(means, path, check)
    rows = spark.read.parquet(path)
    return rows.select("measurement", "host", stamp("window_start").alias("window_start"), r6("mean").alias("mean"))


def streamed(spark: SparkSession, sf: str, halves: bool, settings: Settings, per_tick: int = data.TICK_EVENTS, **options) -> DataFrame:
    """Run the online form over samples that arrive at once or in two parts, stopping and going on after each part."""
    samples, expected = recorded(spark, sf, per_tick)
    source, path, check = (new_dir(spark, n) for n in ("live", "watched", "check"))
    half, tick = data.middle(samples), F.col("tick")
    for part in [tick < half, tick >= half] if halves else [F.lit(True)]:
        timed_samples(samples.where(part)).write.mode("append").json(source)
        stream = src.stream_samples(spark, source, TIMED_SAMPLES)
        arrived = live.tick_stream(stream, expected, "1 second", "0 seconds")
        watched = live.watch_stream(arrived, settings, **options)
        live.run_available(watched, path, check)
    live.end_marker(timed_samples(samples), "ts", "10 seconds").write.mode("append").json(source)
    live.run_available(watched, path, check)
    return spark.read.parquet(path)


def watched_stream(spark: SparkSession, sf: str, halves: bool, settings: Settings = DENSE, **options) -> DataFrame:
    rows = streamed(spark, sf, halves, settings, **options)
    rows = rows.select(
        "cluster", "tick_no", stamp("tick").alias("tick"), "phase_id", "idle", "seen", "version",
        *[f"predicted_{r}" for r in RESOURCES], "step", "confidence", "alert", "acc_cpu", "acc_mem",
    )
    return rounded(rows, *[f"predicted_{r}" for r in RESOURCES], "acc_cpu", "acc_mem")


@query
def stream_anomaly(spark, sf):
    return watched_stream(spark, sf, halves=False)


@query
def stream_restart(spark, sf):
    """The second half arrives after a stop; phases and models come back from the checkpoint, confidence starts anew."""
    return watched_stream(spark, sf, halves=True)


@query
def stream_pairs(spark, sf):
    """Two snapshots per evaluation, as a stream."""
    return watched_stream(spark, sf, halves=False, settings=PAIRS)


@query
def stream_until_alert(spark, sf):
    """Every cluster ends at its own first alert, the others go on."""
    return watched_stream(spark, sf, halves=False, settings=PAIRS, stop_on_alert=True)


@query
def stream_empty_function(spark, sf):
    """A silent worker counts as one with an empty function."""
    return watched_stream(spark, sf, halves=False, empty_function=True)


@query
def stream_missing_worker(spark, sf):
    """Every cluster ends with an alert in the first tick in which one of its workers is missing."""
    rows = streamed(spark, sf, False, DENSE, MISSING_EVENTS, missing_ends=True)
    return rows.select("cluster", stamp("tick").alias("tick"), "tick_no", "confidence", "alert")


def published(spark: SparkSession, sf: str) -> str:
    """The folder of the points that the online form publishes while samples arrive."""
    samples, expected = recorded(spark, sf)
    source, root, check = (new_dir(spark, n) for n in ("live", "points", "check"))
    timed_samples(samples).write.json(source)
    arrived = live.tick_stream(src.stream_samples(spark, source, TIMED_SAMPLES), expected, "1 second", "0 seconds")
    watched = live.watch_stream(arrived, DENSE)
    live.publish(watched, root, check, "runner-live", "hourly")
    live.end_marker(timed_samples(samples), "ts", "10 seconds").write.mode("append").json(source)
    live.publish(watched, root, check, "runner-live", "hourly")
    return root


@query
def stream_latencies(spark, sf):
    """How many ticks of each hour have a latency for each step, from the report's own windows; each latency is a time."""
    root = published(spark, sf)
    found = []
    for name in reports.LATENCY_POINTS[1:]:
        points = tables.read_points(spark, root, name, "runner-live", "hourly").where("latency >= 0 AND latency < 60")
        points = points.withColumn("ticks", F.lit(1.0))
        hours = points.groupBy(*TAGS, F.window("time", "1 hour").start.alias("hour")).agg(F.sum("ticks").cast("long").alias("ticks"))
        found.append(hours.select(F.lit(name).alias("measurement"), *TAGS, stamp("hour").alias("hour"), "ticks"))
    return reduce(DataFrame.unionByName, found)


@query
def stream_points(spark, sf):
    """Prediction points that the online form publishes while samples arrive."""
    root = published(spark, sf)
    rows = tables.read_points(spark, root, "predictions", "runner-live", "hourly")
    fields = ("actual_cpu", "actual_mem", "predicted_cpu", "predicted_mem")
    return rounded(rows.select(stamp("time").alias("time"), *TAGS, *fields), *fields)


@query
def stream_chunks(spark, sf):
    """Traffic logs that arrive as two text files per host, the first of which ends within a chunk."""
    source, path, check = (new_dir(spark, n) for n in ("traffic", "chunks", "check"))
    log = F.regexp_extract("path", "host=([^/]+)/", 1).alias("log")
    for piece in ("line_no < 255", "line_no >= 255"):
        tables.append_lines(data.traffic_lines(spark, sf).where(piece), source, ["host"])
        chunks = live.chunk_stream(src.stream_logs(spark, source).select(log, "written", "value"))
        sizes = chunks.select(F.col("log").alias("host"), "chunk", F.size(F.filter(F.split("lines", "\n"), lambda s: s != "")).alias("lines"))
        live.run_available(sizes, path, check)
    return spark.read.parquet(path)


@query
def stream_resources(spark, sf):
    """Own resource use of every host, from its traffic log as it arrives in two text files, as points of a report."""
    source, root, check = (new_dir(spark, n) for n in ("traffic", "points", "check"))
    watched = store(traffic.process_tree(data.processes(spark, sf), data.main_process()), "watched")
    log = F.regexp_extract("path", "host=([^/]+)/", 1).alias("log")
    at = F.expr(f"timestampadd(SECOND, chunk, TIMESTAMP '{data.ORIGIN} 00:00:00')")
    for piece in ("line_no < 255", "line_no >= 255"):
        tables.append_lines(data.traffic_lines(spark, sf).where(piece), source, ["host"])
        chunks = live.chunk_stream(src.stream_logs(spark, source).select(log, "written", "value"))
        live.publish_resources(chunks, watched, root, check, "traffic", at=at)
    rows = tables.read_points(spark, root, reports.RESOURCE_POINTS, experiment="traffic")
    return rounded(rows.select(stamp("time").alias("time"), *TAGS, *reports.RESOURCE_METRICS), *reports.RESOURCE_METRICS)
