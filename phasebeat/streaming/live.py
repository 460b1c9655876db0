"""The online form: ticks from a watermarked aggregate, then one state per cluster."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from phasebeat.config import RESOURCES, Settings
from phasebeat.functions import text
from phasebeat.functions.errors import SMAPE_EPSILON, ZERO_STAND_IN
from phasebeat.functions.lasso import fit_points
from phasebeat.functions.phases import ARROW
from phasebeat.operators.replay import synthetic_points
from phasebeat.operators.reports import LATENCY_POINTS, RESOURCE_METRICS, RESOURCE_POINTS
from phasebeat.operators.ticks import expected_by_cluster
from phasebeat.operators.traffic import REFRESH, usage_by_chunk
from phasebeat.sources import tables
from phasebeat.streaming.order import RUN_KEY, RUN_VALUE, Runs, in_parts

READING, *_ = LATENCY_POINTS
# The measurement of each step that the state times.
LATENCIES = dict(zip(LATENCY_POINTS[1:], ("predict_seconds", "update_seconds", "detect_seconds"), strict=True))
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RESULT_SCHEMA = (
    "cluster string, tick timestamp, tick_no long, phase_id string, idle boolean, seen boolean, version long, "
    "cpu double, mem double, predicted_cpu double, predicted_mem double, mape double, step long, "
    "confidence long, alert boolean, acc_cpu double, acc_mem double, "
    "predict_seconds double, update_seconds double, detect_seconds double"
)
# Phases whose state is held in memory while the ticks of one cluster are evaluated, and sets of names that a task remembers.
HELD_PHASES = 1024
HELD_SETS = 4096
# Ticks are whole numbers of this unit until they are given back.
TICK_UNIT = "datetime64[us]"


def window_mean_stream(
    points: DataFrame, metric: str, by: list[str], window: str = Settings.window, delay: str = "1 minute"
) -> DataFrame:
    """Tumbling means over a stream of points; a window is emitted once the watermark has passed it."""
    live = points.withWatermark("time", delay).groupBy(*by, F.window("time", window).alias("w"))
    means = live.agg(F.avg(metric).alias("mean")).where("mean != 0")
    return means.select(*by, F.col("w.start").alias("window_start"), "mean")


def end_marker(rows: DataFrame, time: str, after: str) -> DataFrame:
    """One row with nothing but a time ``after`` the last one of ``rows``.

    Added to an input that has ended, it moves the watermark past the last interval, which is then evaluated like
    any other.  Its texts are empty (a null key would be filtered out before the watermark sees it) and
    its numbers null, so it belongs to no result.
    """
    last = rows.agg(F.max(time).alias(time)).select((F.col(time) + F.expr(f"INTERVAL {after}")).alias(time))

    def value(name: str, kind: T.DataType) -> Column:
        if name == time:
            return F.col(name)
        return (F.lit("") if isinstance(kind, T.StringType) else F.lit(None).cast(kind)).alias(name)

    return last.select(*[value(f.name, f.dataType) for f in rows.schema])


def tick_stream(
    samples: DataFrame, expected: DataFrame, interval: str = "2 seconds", delay: str = "2 seconds"
) -> DataFrame:
    """Per cluster and interval: ``said, cpus, mems`` of the last reading of each worker, the distinct functions, the configured workers.

    Newer samples of a worker overwrite older ones first, then workers are put together: one element per worker, and the
    union of their distinct lists of functions.  Names of workers and functions are sorted and travel as JSON texts, which the
    keyed state takes apart once per text; a malformed reading has null resources.

    The join with the configured workers is a merge: Spark sizes a stream by the files of the batch, so the batch of an
    end marker looks tiny while all closed intervals come from the state, and they would be broadcast.
    """
    line = F.col("resource_data")
    reading = F.struct("worker", *[text.resource_field(line, i).alias(r) for i, r in enumerate(RESOURCES)])
    functions = text.sorted_texts(F.array_distinct(F.transform("threaddump_data", text.function_name)))
    newest = F.struct("reading", "functions")
    rows = (
        samples.withWatermark("ts", delay)
        .select("cluster", "worker", "ts", reading.alias("reading"), functions.alias("functions"))
        .groupBy("cluster", "worker", F.window("ts", interval).alias("w"))
        .agg(F.max_by(newest, "ts").alias("s"))
        .select("cluster", F.window_time("w").alias("at"), "s.*")
    )
    live = rows.groupBy("cluster", F.window("at", interval).alias("w")).agg(
        F.sort_array(F.collect_list("reading")).alias("readings"), F.collect_set("functions").alias("lists")
    )
    ticks = live.select(
        "cluster",
        F.col("w.start").alias("tick"),
        F.to_json("readings.worker").alias("said"),
        *[F.col(f"readings.{r}").alias(f"{r}s") for r in RESOURCES],
        F.to_json(text.sorted_texts(F.array_distinct(F.flatten("lists")))).alias("functions"),
    )
    configured = expected_by_cluster(expected).withColumn("workers", F.to_json("workers"))
    return ticks.join(configured.hint("merge"), "cluster")


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """A frame of ticks with whole numbers and lists, which are sorted, put away and added up as they are."""
    lists = {f"{r}s": [x.tolist() for x in frame[f"{r}s"]] for r in RESOURCES}
    return frame.drop(columns="cluster").assign(tick=frame["tick"].astype(TICK_UNIT).astype("int64"), **lists)


def _remembered(known: dict, key, make: Callable):
    """The value of a key, made where it is not known; what is known is forgotten before it grows too large."""
    found = known.get(key)
    if found is None:
        if len(known) >= HELD_SETS:
            known.clear()
        found = known[key] = make()
    return found


class _Entries:
    """A map state seen through what one call has read and changed; written back at its end."""

    def __init__(self, state):
        self.state, self.values, self.changed = state, {}, set()

    def get(self, key: str):
        if key not in self.values:
            self.values[key] = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return self.values[key]

    def put(self, key: str, value: tuple) -> None:
        if self.values.get(key) != value:
            self.values[key] = value
            self.changed.add(key)

    def write(self) -> None:
        """Write what has changed back, and forget it."""
        for key in self.changed:
            self.state.updateValue((key,), self.values[key])
        self.values, self.changed = {}, set()


class ClusterWatcher(StatefulProcessor):
    """Phase, prediction, training and confidence of one cluster, tick by tick.

    Ticks are taken in order from frames that are sorted one by one (``order.Runs``), so what is held does not grow with the ticks of
    a trigger.  A trigger brings intervals that the watermark has closed since the trigger before, so all are later than those.

    With ``stop_on_alert`` a cluster ends at its first alert: it gives no further tick and learns nothing more until the next
    start, while other clusters go on.  With ``missing_ends`` a configured worker that is missing ends its cluster too, as in the
    first variant: the tick is an alert with nothing but its time.
    """

    def __init__(
        self,
        settings: Settings,
        empty_function: bool = False,
        keep_confidence: bool = False,
        stop_on_alert: bool = False,
        missing_ends: bool = False,
    ):
        if settings.variant != "v2":
            raise ValueError("the online form has the semantics of the second variant")
        self.settings, self.empty_function = settings, empty_function
        self.stop_on_alert, self.missing_ends = stop_on_alert, missing_ends
        self.start = uuid.uuid4().hex
        self.keep_confidence = keep_confidence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState(
            "run",
            "snapshots long, cpu1 double, mem1 double, cpu2 double, mem2 double, functions array<string>, "
            "confidence long, ticks long, error_cpu double, error_mem double, start string, ended boolean",
        )
        self.last_state = handle.getMapState("last", "worker string", "cpu double, mem double")
        self.phase_state = handle.getMapState(
            "phases", "phase string", "visits long, pending array<double>, model array<double>"
        )
        self.run_state = handle.getMapState("runs", RUN_KEY, RUN_VALUE)
        # What texts say and how sets compare, for clusters that follow one another in a task.
        self.lists, self.sets, self.compared = {}, {}, {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
        ticks = Runs(self.run_state, "tick").of(map(_plain, rows))
        for part in in_parts(self._evaluated(key[0], ticks), names):
            part["tick"] = part["tick"].astype(TICK_UNIT)
            yield part

    def _evaluated(self, cluster: str, ticks: Iterator[tuple]) -> Iterator[tuple]:
        self.last, self.phases = _Entries(self.last_state), _Entries(self.phase_state)
        run = list(self.run.get()) if self.run.exists() else [0, 0.0, 0.0, 0.0, 0.0, [], 0, 0, 0.0, 0.0, None, False]
        if run[10] != self.start:  # a new start of the analysis
            run[6], run[10], run[11] = run[6] if self.keep_confidence else 0, self.start, False
        # The workers of a cluster, and what they said in the snapshot before; those that were silent there said nothing.
        named, workers, said = None, frozenset(), None
        before = frozenset(run[5])
        for tick in ticks:
            if run[11]:
                continue
            if tick.workers != named:
                self._keep(workers, said)
                named, workers, said = tick.workers, self._set_of(tick.workers), None
            readings = [r for r in zip(self._names(tick.said), tick.cpus, tick.mems) if r[0] in workers]
            silent = len(readings) < len(workers)
            if self.missing_ends and silent:
                run[11] = True
                blank = dict.fromkeys((c.split()[0] for c in RESULT_SCHEMA.split(", ")))
                yield tuple((blank | {"cluster": cluster, "tick": tick.tick, "alert": True}).values())
                continue
            cpu = mem = 0.0
            now = {}
            for worker, c, m in readings:
                if c != c or m != m:
                    old = self.last.get(worker) if said is None else said.get(worker)
                    c, m = (o if v != v else v for v, o in zip((c, m), old or (0.0, 0.0)))
                now[worker] = c, m
                cpu, mem = cpu + c, mem + m
            said = now
            cpu, mem = round(cpu, 9) / len(workers), round(mem, 9) / len(workers)
            functions = self._set_of(tick.functions, silent and self.empty_function)
            run[0] += 1
            if run[0] % self.settings.stride == 0:
                found = self._evaluate(run, cpu, mem, before, functions)
                run[11] = self.stop_on_alert and run[6] > self.settings.confidence_limit
                yield cluster, tick.tick, *found
            run[1:5] = cpu, mem, run[1], run[2]
            before = functions
            if len(self.phases.values) > HELD_PHASES:
                self.phases.write()
        run[5] = sorted(before)
        self._keep(workers, said)
        self.run.update(tuple(run))
        self.last.write()
        self.phases.write()

    def _keep(self, workers: frozenset[str], said: dict[str, tuple[float, float]] | None) -> None:
        """Put the last readings of the workers away; a silent one used nothing."""
        if said is not None:
            for worker in workers:
                self.last.put(worker, said.get(worker, (0.0, 0.0)))

    def _names(self, text: str) -> list[str]:
        """What a JSON text lists."""
        return _remembered(self.lists, text, lambda: json.loads(text))

    def _set_of(self, text: str, empty_too: bool = False) -> frozenset[str]:
        """The same as a set, with an empty name if asked for."""
        return _remembered(self.sets, (text, empty_too), lambda: frozenset(self._names(text) + [""] * empty_too))

    def _phase(self, before: frozenset[str], now: frozenset[str]) -> tuple[str, str]:
        """Text and id of the phase in which one set follows another."""

        def compared() -> tuple[str, str]:
            larger, common = max(len(before), len(now)), before & now
            phase_set = now if larger and len(common) / larger < self.settings.threshold else common
            phase = "".join(f + ARROW for f in sorted(phase_set))
            return phase, hashlib.md5(phase.encode()).hexdigest()

        return _remembered(self.compared, (before, now), compared)

    def _evaluate(self, run: list, cpu: float, mem: float, before: frozenset[str], now: frozenset[str]) -> tuple:
        s, began = self.settings, time.perf_counter()
        prev1_cpu, prev1_mem, prev2_cpu, prev2_mem = run[1:5]
        phase, phase_id = self._phase(before, now)
        idle = phase == ""
        known = None if idle else self.phases.get(phase)
        visits, pending, model = (known[0], known[1], list(known[2])) if known else (0, [], [])
        seen = visits > 0
        version = visits // s.cycle
        if idle:
            to_cpu = to_mem = 0.0
        elif model:
            to_cpu = model[0] * prev2_cpu + model[1] * prev1_cpu + model[2]
            to_mem = model[3] * prev2_mem + model[4] * prev1_mem + model[5]
        else:
            to_cpu, to_mem = prev1_cpu, prev1_mem

        predicted_at = time.perf_counter()

        p, q = to_cpu or ZERO_STAND_IN, to_mem or ZERO_STAND_IN
        mape = (abs((p - (cpu or ZERO_STAND_IN)) / p) + abs((q - (mem or ZERO_STAND_IN)) / q)) / 2.0 * 100.0
        step = 0 if idle else 1 if (mape > s.mape_limit if seen else cpu < s.cpu_floor) else -1
        run[6] += step
        run[7] += 1
        run[8] += abs(cpu - to_cpu) / (abs(cpu) + abs(to_cpu) + SMAPE_EPSILON)
        run[9] += abs(mem - to_mem) / (abs(mem) + abs(to_mem) + SMAPE_EPSILON)
        acc_cpu, acc_mem = 100.0 - run[8] / run[7] * 100.0, 100.0 - run[9] / run[7] * 100.0
        detected_at = time.perf_counter()
        if not idle:
            pending = [*pending, prev2_cpu, prev1_cpu, cpu, prev2_mem, prev1_mem, mem]
            if len(pending) == 6 * s.batch_size:
                model = self._train(phase_id, version + 1, pending, model)
                pending = []
            self.phases.put(phase, (visits + 1, pending, model))
        return (
            run[7], phase_id, idle, seen, 0 if idle else version, cpu, mem, to_cpu, to_mem, mape, step,
            run[6], run[6] > s.confidence_limit, acc_cpu, acc_mem,
            predicted_at - began, time.perf_counter() - detected_at, detected_at - predicted_at,
        )

    def _train(self, phase_id: str, version: int, pending: list[float], model: list[float]) -> list[float]:
        s = self.settings
        if s.algo != "lasso":
            return []
        fitted = []
        for k in range(2):
            places = range(3 * k, len(pending), 6)
            points = [tuple(pending[i : i + 3]) for i in places]
            if model and s.replay:
                old = tuple(model[3 * k : 3 * k + 3])
                points += synthetic_points(phase_id, version, k, old, s.replay, s.seed)
            fitted += fit_points(points, s.alpha)
        return fitted


def watch_stream(
    ticks: DataFrame,
    settings: Settings = Settings(),
    empty_function: bool = False,
    keep_confidence: bool = False,
    stop_on_alert: bool = False,
    missing_ends: bool = False,
) -> DataFrame:
    """Evaluated ticks of a stream of cluster ticks.

    Each call is a new start: phases and models go on from the checkpoint, the confidence begins at zero unless it is kept.
    Input is aggregated already, one row per cluster and interval, so even a cluster that
    sends a third of all samples is a thin sequence here.  With ``stop_on_alert`` each cluster ends at its own first alert, with
    ``missing_ends`` at the first tick in which a configured worker is missing.
    The last three columns are the seconds that predicting, updating the model and scoring took.
    """
    return ticks.groupBy("cluster").transformWithStateInPandas(
        statefulProcessor=ClusterWatcher(settings, empty_function, keep_confidence, stop_on_alert, missing_ends),
        outputStructType=RESULT_SCHEMA,
        outputMode="append",
        timeMode="none",
    )


class ChunkCarrier(StatefulProcessor):
    """Closed chunks of one log; the text after the last mark waits for the next piece."""

    def __init__(self, mark: str):
        self.mark = re.compile(rf"^{re.escape(mark)}\n", re.MULTILINE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "chunks long, tail string")
        self.run_state = handle.getMapState("runs", RUN_KEY, RUN_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks, tail = self.open.get() if self.open.exists() else (0, "")
        # Pieces are whole files, so a block of a run is one piece.
        for piece in Runs(self.run_state, "written", block_rows=1).of(rows):
            *closed, tail = self.mark.split(tail + piece.value)
            if closed:
                yield pd.DataFrame({"log": key[0], "chunk": range(chunks, chunks + len(closed)), "lines": closed})
            chunks += len(closed)
        self.open.update((chunks, tail))


def chunk_stream(pieces: DataFrame, mark: str = REFRESH) -> DataFrame:
    """``log, chunk, lines`` of pieces ``log, written, value``; a chunk may span any number of pieces and triggers."""
    return pieces.groupBy("log").transformWithStateInPandas(
        statefulProcessor=ChunkCarrier(mark), outputStructType="log string, chunk long, lines string", outputMode="append", timeMode="none"
    )


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Settings of keyed state while a query is started: its store and its number of partitions.

    The first start fixes that number for the life of a checkpoint, so it is an argument and not taken from the cores there are;
    without it the session's number of shuffle partitions holds.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class LateRows(RuntimeError):
    """Samples came after the interval they belong to had been closed; ``count`` of them are in no result."""

    def __init__(self, count: int):
        super().__init__(f"{count} rows came later than the allowed delay and are in no result")
        self.count = count


@dataclass
class Progress:
    """What the micro-batches of one start have reported: rows that came too late, seconds of reading by batch, alerts by batch."""

    late: int = 0
    reading: dict[int, float] = field(default_factory=dict)
    alerts: dict[int, int] = field(default_factory=dict)
    seen: set[str] = field(default_factory=set)

    def take(self, query: StreamingQuery) -> None:
        for p in query.recentProgress:
            if p["timestamp"] in self.seen:
                continue
            self.seen.add(p["timestamp"])
            self.late += sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
            if p["numInputRows"]:
                took = p["durationMs"]
                self.reading[p["batchId"]] = sum(took.get(step, 0) for step in ("latestOffset", "getBatch")) / 1000

    @property
    def alerted(self) -> int:
        return sum(self.alerts.values())


def _finished(query: StreamingQuery, progress: Progress, late: str, done: Callable[[], bool] = lambda: False) -> Progress:
    """Wait for the end of a query, or until ``done``; rows that come too late end it unless they are only counted."""
    if late not in ("fail", "count"):
        raise ValueError(f"late rows either fail or count, not {late!r}")
    ended = False
    while not ended:
        ended = query.awaitTermination(0.2)
        progress.take(query)
        if progress.late and late == "fail":
            query.stop()
            raise LateRows(progress.late)
        if not ended and done():
            query.stop()
    return progress


def publish(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    host: str,
    experiment: str,
    stop_after: int | None = None,
    partitions: int | None = None,
    late: str = "fail",
    **trigger,
) -> Progress:
    """Write prediction, accuracy, alert and latency points of a watched stream.

    A micro-batch that is repeated after a failure replaces its own points.  ``stop_after`` ends the query after so many alerts:
    with clusters that end at their first alert, the number of clusters.  Rows later than the watermark allows raise ``LateRows``
    with their number, after the batch that met them; with ``late="count"`` they are only counted in what is returned.
    """
    progress = Progress()

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        tags = [F.col("tick").alias("time"), F.lit(host).alias("host"), F.lit(experiment).alias("experiment_name")]
        points = batch.select("*", *tags, F.lit(number).alias("batch"))
        evaluated = points.where("tick_no IS NOT NULL")
        for name, rows in (
            ("predictions", tables.prediction_points(evaluated, "batch")),
            ("accuracy", tables.accuracy_points(evaluated, "batch")),
            (tables.ALERTS, tables.alert_points(points, "batch")),
            *((n, evaluated.select(*tables.TAG_COLUMNS, F.col(c).alias("latency"), "batch")) for n, c in LATENCIES.items()),
        ):
            tables.replace_points(rows, root, name)
        progress.alerts[number] = batch.where("alert").count()
        batch.unpersist()

    spark = stream.sparkSession
    with state_store(spark, partitions):
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    try:
        return _finished(query, progress, late, lambda: stop_after is not None and progress.alerted >= stop_after)
    finally:
        rows = [(host, experiment, seconds, batch) for batch, seconds in progress.reading.items()]
        if rows:
            read = spark.createDataFrame(rows, "host string, experiment_name string, latency double, batch long")
            tables.replace_points(read.withColumn("time", F.current_timestamp()), root, READING)


def publish_resources(
    chunks: DataFrame,
    watched: DataFrame,
    root: str,
    checkpoint: str,
    experiment: str,
    exact: bool = False,
    at: Column | None = None,
    partitions: int | None = None,
    **trigger,
) -> None:
    """Write the own resource use of every closed chunk ``log, chunk, lines`` as points of the host that the log is named after.

    A chunk is closed as a whole, so its lines are in one micro-batch and are joined with the process table there; a chunk without
    lines is a point of zeros.  The time of a point is ``at``, or that of its arrival.
    """
    when = F.current_timestamp() if at is None else at

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("log").alias("host"), "chunk", F.explode(F.split("lines", "\n")).alias("line"))
        used = usage_by_chunk(rows, watched, ["host", "chunk"], exact=exact)
        points = used.select(
            when.alias("time"), "host", F.lit(experiment).alias("experiment_name"), *RESOURCE_METRICS, F.lit(number).alias("batch")
        )
        tables.replace_points(points, root, RESOURCE_POINTS)

    with state_store(chunks.sparkSession, partitions):
        query = (
            chunks.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    _finished(query, Progress(), "count")


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None, late: str = "fail"
) -> Progress:
    """Process what has arrived, appending to a parquet folder, and stop; rows that come too late raise ``LateRows``."""
    with state_store(stream.sparkSession, partitions):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    return _finished(query, Progress(), late)
