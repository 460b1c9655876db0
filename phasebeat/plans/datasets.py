"""The analysis' inputs, derived from the driver's tables.

``events`` becomes metric points, worker samples, process samples and step logs; the other tables give
process trees, statistics lines and text.  Every adapter reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasebeat.functions import text
from phasebeat.operators.ordered import whole_part
from phasebeat.operators.ticks import TICK, unique_by_tick

# Ticks are seconds from this date.
ORIGIN = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Consecutive events per tick: ticks, and so samples, grow with the events.
TICK_EVENTS = 4
# Users of a cluster besides the hot one, and functions that run for an event.
CLUSTER_USERS = 15
FUNCTIONS = 12


def events(spark: SparkSession, sf_dir: str, per_tick: int = TICK_EVENTS) -> DataFrame:
    """Events with the number of their tick and the whole-number property."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumns(
        {"k": F.get_json_object("props", "$.k").cast("long"), "tick": whole_part("event_id", per_tick)}
    ).drop("props")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a point of the measurement named after its type."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("measurement"),
        F.col("ts").alias("time"),
        F.concat(F.lit("runner-"), (F.col("user_id") % 5).cast("string")).alias("host"),
        F.concat(F.lit("exp-"), (F.col("user_id") % 3).cast("string")).alias("experiment_name"),
        "value",
        F.col("k").cast("double").alias("k"),
        "event_id",
    )


def cluster_of(user: Column) -> Column:
    """Every third user is in the hot cluster ``c0``, the others are in a cluster for each fifteen of them."""
    group = F.floor(user / CLUSTER_USERS).cast("long") + 1
    return F.concat(F.lit("c"), F.when(user % 3 == 0, F.lit(0)).otherwise(group).cast("string"))


def worker_of(user: Column) -> Column:
    """Five workers in each cluster."""
    return F.concat(F.lit("w"), (F.floor(user / 3).cast("long") % 5).cast("string"))


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    rows = table(spark, sf_dir, "events")
    return rows.select(cluster_of(user).alias("cluster"), worker_of(user).alias("worker")).distinct()


def resource_line(value: Column, k: Column, number: Column) -> Column:
    """``cpu,mem`` text; some lines are broken in each of the ways that occur."""
    cpu, mem = value.cast("decimal(18,2)").cast("string"), k.cast("string")
    return (
        F.when(number % 17 == 0, F.concat(cpu, F.lit(",")))
        .when(number % 19 == 0, F.concat(cpu, F.lit(",abc")))
        .when(number % 23 == 0, F.concat(cpu, F.lit(","), mem, F.lit(",9")))
        .when(number % 29 == 0, F.lit(""))
        .otherwise(F.concat(cpu, F.lit(","), mem))
    )


def samples(spark: SparkSession, sf_dir: str, with_functions: bool = True, per_tick: int = TICK_EVENTS) -> DataFrame:
    """The last resource line of each worker and tick, and its functions with thread counts."""
    rows = events(spark, sf_dir, per_tick)
    user = F.col("user_id")
    # The functions of an event follow from the texts around their numbers, which are all that is shuffled.
    head = F.concat(F.lit(" "), F.col("event_type"), F.lit(".step"))
    tail = F.concat(F.lit(" *** "), (F.col("k") % 4).cast("string"), F.lit("\n"))
    job = F.struct(head.alias("head"), tail.alias("tail"))
    step = F.array(*[F.lit(str(i + 1)) for i in range(FUNCTIONS)])
    rows = rows.select(
        cluster_of(user).alias("cluster"),
        worker_of(user).alias("worker"),
        "tick",
        "event_id",
        resource_line(F.col("value"), F.col("k"), F.col("event_id")).alias("line"),
        job.alias("job"),
    )
    found = [F.max_by("line", "event_id").alias("resource_data")]
    if not with_functions:
        return rows.groupBy("cluster", "worker", "tick").agg(*found)
    # Dealt by tick at once, so that the ticks need no other shuffle, which would be of texts.
    rows = rows.repartition(*TICK)
    # In every seventh tick no process runs.
    jobs = F.collect_set(F.when(F.col("tick") % 7 != 0, F.col("job"))).alias("jobs")
    rows = rows.groupBy("cluster", "worker", "tick").agg(*found, jobs)
    funcs = F.flatten(F.transform("jobs", lambda j: F.transform(step, lambda i: F.concat(j["head"], i, j["tail"]))))
    found = F.array_distinct(funcs)
    # An event without a type or a number has functions that are null; one of them comes last.
    unknown = F.when(F.exists("jobs", lambda j: j["head"].isNull() | j["tail"].isNull()), F.array(F.lit(None).cast("string")))
    threaddump_data = F.concat(text.sorted_texts(found), F.coalesce(unknown, F.array().cast("array<string>")))
    return unique_by_tick(rows.withColumn("threaddump_data", threaddump_data).drop("jobs"))


def middle(samples: DataFrame) -> int:
    """The tick halfway through the samples."""
    return (samples.agg(F.max("tick")).first()[0] or 0) // 2


def process_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent sees in each tick: the pid of the executor, if any, and a line about it."""
    rows = events(spark, sf_dir)
    user = F.col("user_id")
    last = F.max_by(F.struct("event_type", "value", "k", "event_id"), "event_id").alias("e")
    rows = rows.select(
        cluster_of(user).alias("cluster"), worker_of(user).alias("worker"), "tick", "event_type", "value", "k", "event_id"
    )
    rows = rows.groupBy("cluster", "worker", "tick").agg(last)
    name = F.when(F.col("e.event_type") == "error", F.lit("Jps")).otherwise(F.lit(text.EXECUTOR_CLASS))
    header = F.lit("PID USER %CPU %MEM")
    line = F.when(F.col("e.k") % 7 == 0, header).otherwise(
        F.concat(F.col("e.value").cast("decimal(18,2)").cast("string"), F.lit(","), F.col("e.k").cast("string"))
    )
    pid = F.when(F.col("e.event_type") != "error", F.col("e.k") % 3 + 100)
    return rows.select("cluster", "worker", "tick", name.alias("name"), pid.alias("pid"), line.alias("line"))


def dump_block() -> Column:
    """What an event adds to a dump: a count line and a stack; some lack the count, some the empty line at the end."""
    n = F.col("event_id")
    head = F.concat((F.col("k") % 9 + 1).cast("string"), F.lit(" threads with trace\n"))
    frames = F.concat(
        F.lit("Stack:\n"),
        F.when(F.col("k") % 2 == 0, F.lit("at org.apache.spark.")).otherwise(F.lit("at java.util.")),
        "event_type",
        F.lit(" <0x00"),
        (n % 16).cast("string"),
        F.lit(">\nat run\n"),
    )
    end = F.when(n % 13 == 0, F.lit("")).otherwise(F.lit("\n"))
    return F.concat(F.when(n % 11 == 0, F.lit("")).otherwise(head), frames, end)


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of many dumps, one of which holds every third event."""
    n = F.col("event_id")
    dump_no = F.when(n % 3 == 0, F.lit(0)).otherwise(whole_part("event_id", 1000) + 1)
    # The text of a block ends in a newline, so the last part is empty.
    lines = F.posexplode(F.slice(F.split(dump_block(), "\n", -1), 1, F.size(F.split(dump_block(), "\n", -1)) - 1))
    rows = events(spark, sf_dir).select(dump_no.alias("dump_no"), "event_id", lines.alias("at", "line"))
    return rows.select("dump_no", (F.col("event_id") * 10 + F.col("at")).alias("line_no"), "line")


def dumps(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """An aggregated dump text for every ``size`` events: blocks of a count line and a stack."""
    rows = events(spark, sf_dir)
    block = dump_block()
    rows = rows.select(whole_part("event_id", size).alias("dump_no"), F.struct("event_id", block.alias("block")).alias("b"))
    blocks = F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"])
    return rows.groupBy("dump_no").agg(F.array_join(blocks, "").alias("value"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed steps: each event is one, and lasted its value in milliseconds."""
    rows = points(spark, sf_dir)
    span = F.expr("make_dt_interval(0, 0, 0, cast(value as decimal(18,2)) / 1000)")
    return rows.select(
        F.concat("measurement", F.lit("_latency")).alias("step"),
        F.col("time").alias("start"),
        (F.col("time") + span).alias("end"),
        "host",
        "experiment_name",
    )


# Events per host in the process tables and traffic logs.
HOST_EVENTS = 500


def _host() -> Column:
    return F.concat(F.lit("host-"), whole_part("event_id", HOST_EVENTS).cast("string"))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process tables of many hosts: four children for each process, use from the event."""
    pid = F.col("event_id") % HOST_EVENTS
    return events(spark, sf_dir).select(
        _host().alias("host"),
        pid.alias("pid"),
        F.when(pid > 0, F.floor((pid - 1) / 4)).alias("ppid"),
        F.col("value").alias("cpu"),
        F.col("k").cast("double").alias("mem"),
    )


def main_process() -> Column:
    """The main process has pid 10, 11 or 12; every fourth host has none."""
    number = F.substring_index("host", "-", -1).cast("long") % 4
    return (number < 3) & (F.col("pid") == number + 10)


def traffic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic logs of many hosts: a line per event, some of other kinds, a mark every tenth line or less."""
    n = F.col("event_id") % HOST_EVENTS
    numbers = F.concat(
        F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" "), F.col("k").cast("string")
    )
    line = (
        F.when((n % 10 == 9) | (n % 50 == 10), F.lit("Refreshing:"))
        .when(F.col("event_type") == "error", F.lit("short 1"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("ssh/"), F.col("k").cast("string"), F.lit("/0"), numbers))
        .otherwise(F.concat(F.lit("java/"), F.col("k").cast("string"), F.lit("/0"), numbers))
    )
    return events(spark, sf_dir).select(_host().alias("host"), n.alias("line_no"), line.alias("line"))


def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics files of three algorithms: five lines per order, some runs failed, all of one workload among them."""
    order = F.col("o_orderkey")
    broken = order % 41 == 0
    name = F.when(broken, F.lit("broken")).otherwise(F.substring_index("o_orderpriority", "-", -1))
    cpu, mem = F.col("o_totalprice") % 100, F.col("o_custkey") % 100
    lines = F.array(
        F.regexp_replace(name, " ", "_"),
        F.when(order % 31 == 0, F.lit("run failure")).otherwise(F.lit("")),
        F.lit("### Accuracy Rates ###"),
        F.when(broken | (order % 37 == 0), F.lit("no value")).otherwise(
            F.concat(F.lit("CPU Prediction Accuracy: "), cpu.cast("decimal(18,3)").cast("string"))
        ),
        F.when(broken, F.lit("")).otherwise(
            F.concat(F.lit("MEM Prediction Accuracy: "), mem.cast("decimal(18,3)").cast("string"))
        ),
    )
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("algo"), order.alias("o"), F.posexplode(lines).alias("i", "line")
    )
    return rows.select("algo", (F.col("o") * 5 + F.col("i")).cast("long").alias("line_no"), "line")


# Fixed value: a line with this text marks a failed run in the statistics lines above.
FAILED_RUN = "run failure"


def report_points(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Points of every measurement of the full report, each event type giving one or two of them."""
    rows = points(spark, sf_dir)
    value, k = F.col("value"), F.col("k")
    tags = ["time", "host", "experiment_name"]

    def of(kind: str, **fields: Column) -> DataFrame:
        return rows.where(F.col("measurement") == kind).select(*tags, *[c.alias(n) for n, c in fields.items()])

    even = k % 2 == 0
    return {
        "monitor_resource_consumption": of(
            "view", cpu=value, mem=k, download=F.when(even, value), upload=F.when(k % 3 == 0, F.lit(0.0)).otherwise(k)
        ),
        "predictions": of(
            "click", actual_cpu=value, actual_mem=k, predicted_cpu=F.when(k % 5 != 0, value + 1.0), predicted_mem=k + 1.0
        ),
        "accuracy": of("purchase", acc_cpu=value / 2.0, acc_mem=100.0 - k),
        "data_collection_latency": of("purchase", latency=k),
        "prediction_latency": of("signup", latency=value),
        "ml_model_update_latency": of("error", latency=F.when(even, value)),
        "anomaly_detection_latency": of("error", latency=F.when(~even, value)),
    }
