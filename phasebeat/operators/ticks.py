"""From worker samples to cluster snapshots and triplets."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.config import RESOURCES, Settings
from phasebeat.functions import text
from phasebeat.operators.ordered import scan, whole_part
from phasebeat.workspace import narrowed, store

TICK = ["cluster", "tick"]
SET_IDS = ["set_id_prev1", "set_id"]
# Into so many parts the rows of one frequent set are split before they are joined with its texts.
SALTS = 16
# So many rows of a written table are sent to every task as they are.
SENT_ROWS = 1 << 14


def latest_samples(samples: DataFrame, order: str = "ts", keys: tuple[str, ...] = ("cluster", "worker")) -> DataFrame:
    """The newest sample per worker: each new one overwrites the one before."""
    rest = [c for c in samples.columns if c not in keys]
    newest = samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s"))
    return newest.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def polled(timed: DataFrame, interval: float = 2.0) -> DataFrame:
    """Number timed samples by interval and keep the newest per worker and interval, as a poll would see it."""
    micros = int(interval * 1_000_000)
    at = timed.withColumn("micros", F.unix_micros("ts"))
    rows = at.withColumn("tick", whole_part("micros", micros)).drop("micros")
    return latest_samples(rows, "ts", ("cluster", "worker", "tick"))


def expected_by_cluster(expected: DataFrame) -> DataFrame:
    """One row per cluster: its configured workers."""
    return expected.groupBy("cluster").agg(F.array_sort(F.collect_set("worker")).alias("workers"))


def missing_workers(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """(cluster, tick, worker) for each configured worker without a sample in a tick that others have.

    One pass with map-side combine: the set of present workers per tick is at most as large as
    the cluster, and the set difference needs no pairing of workers with ticks.
    """
    present = samples.groupBy(*TICK).agg(F.collect_set("worker").alias("present"))
    gaps = present.join(expected_by_cluster(expected), "cluster")
    return gaps.select(*TICK, F.explode(F.array_except("workers", "present")).alias("worker"))


def missing_ends(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """``cluster, end``: the first tick in which a configured worker is missing; other clusters have no row."""
    return missing_workers(samples, expected).groupBy("cluster").agg(F.min("tick").alias("end"))


def with_silent_workers(samples: DataFrame, expected: DataFrame, empty_function: bool = False) -> DataFrame:
    """Add a ``0,0`` sample for each silent worker, with one empty function if asked for."""
    functions = F.array(F.lit("")) if empty_function else F.array().cast("array<string>")
    silent = missing_workers(samples, expected).withColumns(
        {"resource_data": F.lit(text.IDLE_LINE), "threaddump_data": functions}
    )
    return samples.select(silent.columns).unionByName(silent)


def parse_resources(samples: DataFrame, accept_non_finite: bool = False) -> DataFrame:
    """Add ``cpu`` and ``mem``, null where the text line is malformed."""
    n, parts = len(RESOURCES), F.col("parts")
    # Most rows of sparse clusters are silent workers, whose line needs no parsing.
    idle = F.coalesce(F.col("resource_data") == text.IDLE_LINE, F.lit(False))
    rows = samples.withColumn("parts", F.when(~idle, F.split("resource_data", ",", -1)))
    return rows.withColumns(
        {r: F.when(idle, F.lit(0.0)).otherwise(text.field_number(parts, i, n, accept_non_finite)) for i, r in enumerate(RESOURCES)}
    ).drop("parts")


def fill_forward(parsed: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Replace a malformed value by the last good one of the same worker, 0.0 at the start."""
    last = {f"last_{r}": F.col(r) for r in RESOURCES}
    known = scan(parsed, ["cluster", "worker"], "tick", lasts=last, segment_rows=segment_rows)
    return known.withColumns({r: F.coalesce(r, f"last_{r}", F.lit(0.0)) for r in RESOURCES}).drop(*last)


def cluster_means(filled: DataFrame, expected: DataFrame, flag_malformed: bool = False) -> DataFrame:
    """Mean per resource and tick over the *configured* workers, however many reported.

    Sums are rounded to nine places so that the order of adding cannot move a value across
    a limit.
    """
    sums = [F.round(F.sum(r), 9).alias(r) for r in RESOURCES]
    if flag_malformed:
        sums.append(F.max(reduce(or_, [F.col(r).isNull() for r in RESOURCES])).alias("malformed"))
    ticks = filled.groupBy(*TICK).agg(*sums)
    counts = expected.groupBy("cluster").agg(F.count_distinct("worker").alias("workers"))
    ticks = ticks.join(counts, "cluster")
    return ticks.withColumns({r: F.col(r) / F.col("workers") for r in RESOURCES}).drop("workers")


def function_lines(samples: DataFrame) -> Column:
    return F.transform(F.col("threaddump_data"), text.strip)


def function_union(samples: DataFrame, with_counts: bool = False) -> DataFrame:
    """Distinct functions per cluster and tick over all workers, sorted.

    ``with_counts`` also keeps the lines with their thread counts, as the first variant
    compares them.  Duplicates go by a plain hash aggregation before and after the shuffle; only
    what remains is put into arrays, so no group is larger than its result.
    """
    lines = samples.select(*TICK, F.explode(function_lines(samples)).alias("line"))
    cut = text.drop_thread_count(F.col("line"))
    if not with_counts:
        found = lines.select(*TICK, cut.alias("line")).distinct()
        return found.groupBy(*TICK).agg(F.array_sort(F.collect_list("line")).alias("funcs"))
    sets = lines.distinct().groupBy(*TICK).agg(F.array_sort(F.collect_list("line")).alias("counted"))
    plain = F.array_sort(F.array_distinct(F.transform("counted", text.drop_thread_count)))
    return sets.withColumn("funcs", plain)


def unique_by_tick(samples: DataFrame) -> DataFrame:
    """Mark samples that an aggregation has made, one per worker and tick, out of rows dealt by ``TICK``.

    Nothing in them is equal, and the rows of a tick are together already.
    """
    samples._phasebeat_unique = True
    return samples


def gathered(samples: DataFrame, with_counts: bool = False, unique: bool = False) -> DataFrame:
    """``readings`` of the workers and ``lines`` of all their stacks per cluster and tick, from one pass over the samples.

    Samples are shuffled once, as they are. Behind that shuffle equal samples become one with a number, by a plain hash aggregation,
    and the rest of a tick is put into arrays: one element per worker, and the union of the distinct lists of functions.
    Parsed resources are kept beside their text if the samples have them.  ``unique`` samples are those of ``unique_by_tick``: they
    need neither that shuffle nor that aggregation.
    """
    told = ["worker", "resource_data", *[r for r in RESOURCES if r in samples.columns]]
    if not unique:
        samples = samples.select(*TICK, *told, "threaddump_data").repartition(*TICK)
    lines = function_lines(samples) if with_counts else F.transform("threaddump_data", text.function_name)
    rows = samples.select(*TICK, *told, lines.alias("lines"))
    one = F.lit(1).cast("long").alias("n")
    distinct = rows.select("*", one) if unique else rows.groupBy(*TICK, *told, "lines").agg(F.count("*").alias("n"))
    return distinct.groupBy(*TICK).agg(
        F.collect_list(F.struct(*told, "n")).alias("readings"),
        text.sorted_texts(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines"),
    )


def readings(gathered_ticks: DataFrame, expected: DataFrame) -> DataFrame:
    """The readings as rows again, with a ``0,0`` sample for each configured worker that has none."""
    said = F.transform("readings", lambda r: r["worker"])
    silent = F.transform(
        F.array_except("workers", said),
        lambda w: F.struct(w.alias("worker"), F.lit(text.IDLE_LINE).alias("resource_data"), F.lit(1).cast("long").alias("n")),
    )
    ticks = gathered_ticks.select(*TICK, "readings").join(expected_by_cluster(expected), "cluster", "left")
    every = F.when(F.col("workers").isNull(), F.col("readings")).otherwise(F.concat("readings", silent))
    rows = ticks.select(*TICK, F.explode(every).alias("r")).select(*TICK, "r.*")
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")


def measured(samples: DataFrame, expected: DataFrame, with_counts: bool = False) -> DataFrame:
    """``gathered`` with parsed resources, written once, for the clusters that have configured workers.

    ``workers`` is their number, ``silent`` says that one of them has no sample, ``strangers`` are workers that are not configured.
    ``lines`` are named ``counted`` if they keep their thread counts.
    """
    unique = getattr(samples, "_phasebeat_unique", False)
    found = gathered(parse_resources(samples), with_counts, unique).where("tick IS NOT NULL").join(expected_by_cluster(expected), "cluster")
    said = F.transform("readings", lambda r: r["worker"])
    rows = found.select(
        *TICK,
        "readings",
        F.col("lines").alias("counted" if with_counts else "lines"),
        F.size("workers").alias("workers"),
        (F.size(F.array_except("workers", said)) > 0).alias("silent"),
        F.array_except(said, "workers").alias("strangers"),
    )
    return store(rows, "gathered")


def cluster_ticks(
    samples: DataFrame,
    expected: DataFrame,
    settings: Settings = Settings(),
    segment_rows: int | None = None,
    empty_function: bool = False,
) -> DataFrame:
    """One snapshot per cluster and tick: mean resources and the set of functions.

    The samples are read once; readings and functions go on from one written row per tick.
    """
    found = measured(samples, expected, with_counts=settings.variant == "v1")
    return measured_ticks(found, settings, segment_rows, empty_function)


def measured_ticks(
    found: DataFrame, settings: Settings = Settings(), segment_rows: int | None = None, empty_function: bool = False
) -> DataFrame:
    """The snapshots of ``measured`` samples; samples with thread counts serve both variants.

    Means are those of ``cluster_means`` after ``fill_forward``, but silent workers, which add zeros, get no rows of their own.
    """
    v1 = settings.variant == "v1"
    lines, rows = F.col("counted" if "counted" in found.columns else "lines"), found
    if not v1 and "counted" in found.columns:
        lines = _without_counts(lines)
    if empty_function:
        # A silent worker has one empty function.
        lines = F.when(F.col("silent"), F.array_sort(F.array_union(lines, F.array(F.lit(""))))).otherwise(lines)
    if v1:
        sums = {r: F.coalesce(_good_sum(r), F.when(F.col("silent"), F.lit(0.0))) for r in RESOURCES}
        rows = rows.withColumn("malformed", F.exists("readings", _malformed))
    else:
        # Both sides grow with the ticks and compress well, so they are never broadcast.
        rows = _named_workers(rows).join(filled_sums(found, segment_rows).hint("merge"), TICK, "left")
        sums = {r: F.coalesce(_good_sum(r), F.lit(0.0)) + F.coalesce(f"filled_{r}", F.lit(0.0)) for r in RESOURCES}
    means = [(F.round(c, 9) / F.col("workers")).alias(r) for r, c in sums.items()]
    if v1:
        ticks = rows.select(*TICK, *means, "malformed", lines.alias("counted")).withColumn("funcs", _without_counts(F.col("counted")))
    else:
        ticks = rows.select(*TICK, *means, lines.alias("funcs"))
    return ticks.withColumn("set_id", set_id(set_columns(ticks)))


def _without_counts(lines: Column) -> Column:
    return text.sorted_texts(F.array_distinct(F.transform(lines, text.drop_thread_count)))


def _malformed(reading: Column) -> Column:
    return reduce(or_, [reading[r].isNull() for r in RESOURCES])


def _good_sum(resource: str) -> Column:
    """Sum of the good values of a tick, null if there are none."""
    values = F.filter(F.transform("readings", lambda x: x[resource] * x["n"]), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))


def _named_workers(found: DataFrame) -> DataFrame:
    return found.withColumn("readings", F.filter("readings", lambda x: x["worker"].isNotNull()))


def filled_sums(found: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """What the malformed readings of ``measured`` ticks add to the sums, as ``fill_forward`` fills them.

    A configured worker has a value in every tick of its cluster. So a malformed one takes that of the tick before: zero if the worker
    was silent there or there is none. Only what was malformed there too is looked for further back, among the malformed readings.
    A worker that is not configured has no silent ticks, so all its readings are kept.
    """
    narrow = narrowed(found, *TICK, "readings", "strangers")
    rows = scan(narrow, ["cluster"], "tick", lags={"tick_before": ("tick", 1)}, segment_rows=segment_rows)
    strange = F.coalesce(F.array_contains("strangers", F.col("worker")), F.lit(False))
    asked = F.filter(
        "readings", lambda x: _malformed(x) | F.coalesce(F.array_contains("strangers", x["worker"]), F.lit(False))
    )
    asked = _named_workers(rows).select(*TICK, "tick_before", "strangers", F.explode(asked).alias("r")).select("*", "r.*").drop("r")
    earlier = found.select("cluster", F.col("tick").alias("tick_before"), F.explode("readings").alias("r"))
    earlier = earlier.groupBy("cluster", "tick_before", F.col("r.worker").alias("worker")).agg(
        *[F.max(f"r.{r}").alias(f"before_{r}") for r in RESOURCES], F.lit(True).alias("spoke")
    )
    asked = asked.join(earlier.hint("merge"), ["cluster", "tick_before", "worker"], "left")
    last = {
        f"near_{r}": F.coalesce(r, F.when(~strange, F.when(F.col("spoke"), F.col(f"before_{r}")).otherwise(F.lit(0.0))))
        for r in RESOURCES
    }
    asked = asked.select(*TICK, "worker", "n", *RESOURCES, *[c.alias(n) for n, c in last.items()])
    lasts = {f"far_{r}": F.col(f"near_{r}") for r in RESOURCES}
    filled = scan(asked, ["cluster", "worker"], "tick", lasts=lasts, segment_rows=segment_rows)
    values = {r: F.when(F.col(r).isNull(), F.coalesce(f"near_{r}", f"far_{r}", F.lit(0.0)) * F.col("n")) for r in RESOURCES}
    return filled.groupBy(*TICK).agg(*[F.sum(v).alias(f"filled_{r}") for r, v in values.items()])


def set_columns(ticks: DataFrame) -> list[str]:
    return [c for c in ("funcs", "counted") if c in ticks.columns]


def set_id(columns: list[str]) -> Column:
    """Short id of the sets of a tick; the quotes of JSON keep different sets apart."""
    return F.md5(F.to_json(F.struct(*columns)))


def ordered_triplets(
    ticks: DataFrame,
    settings: Settings = Settings(),
    segment_rows: int | None = None,
    before: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Each evaluated snapshot with the two before it, by numbers and set ids only, and the dictionary of the sets.

    With a stride of two, every second snapshot is evaluated.  ``before`` holds the last snapshots of
    an earlier run: they serve as history and are not evaluated again.
    """
    sets = set_columns(ticks)
    # Written ticks have their ids and are not written again.
    if "set_id" not in ticks.columns:
        ticks = ticks.withColumns({"set_id": set_id(sets)})
    narrow = narrowed(ticks, *[c for c in ticks.columns if c not in sets])
    if "malformed" in ticks.columns:
        narrow = _complete_pairs(narrow, settings.stride, segment_rows)
    names = ticks.select(*sets)
    fresh = F.lit(1)
    if before is not None:
        old = before.withColumn("set_id", set_id(sets))
        names = names.unionByName(old.select(*sets))
        narrow = narrow.withColumn("fresh", F.lit(1)).unionByName(old.select(*narrow.columns).withColumn("fresh", F.lit(0)))
        fresh = F.col("fresh")
    lags = {f"{r}_prev{n}": (r, n) for r in RESOURCES for n in (1, 2)} | {"set_id_prev1": ("set_id", 1)}
    rows = scan(narrow, ["cluster"], "tick", sums={"snapshot_no": fresh}, lags=lags, segment_rows=segment_rows)
    nothing = hashlib.md5(json.dumps({s: [] for s in sets}, separators=(",", ":")).encode()).hexdigest()
    rows = rows.where((F.col("snapshot_no") % settings.stride == 0) & (F.lit(before is None) | (fresh == 1)))
    rows = rows.withColumns(
        {"tick_no": whole_part("snapshot_no", settings.stride)}
        | {f"{r}_prev{n}": F.coalesce(f"{r}_prev{n}", F.lit(0.0)) for r in RESOURCES for n in (1, 2)}
        | {"set_id_prev1": F.coalesce("set_id_prev1", F.lit(nothing))}
    ).drop("snapshot_no", "fresh")
    return rows, names.distinct().withColumn("set_id", set_id(sets))


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` with the columns of ``small``, whose keys are unique; a key that most rows have is dealt over ``SALTS`` parts.

    The join is a merge: Spark sizes the parts of ``small`` as if there were one, and a written table by its compressed bytes.
    """
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(dealt.hint("merge"), [*keys, "__salt"], "left").drop("__salt")


def join_written(rows: DataFrame, small: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``spread_join`` with a table that ``store`` has written; if its rows are counted to be few, ``rows`` are not shuffled."""
    if small.count() <= SENT_ROWS:
        return rows.join(F.broadcast(small), keys, "left")
    return spread_join(rows, small, keys, by)


def with_sets(rows: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """Add the texts of the sets; those of no snapshot are empty."""
    sets = set_columns(names)
    earlier = names.select(F.col("set_id").alias("set_id_prev1"), *[F.col(s).alias(f"{s}_prev1") for s in sets])
    found = spread_join(spread_join(rows, names, ["set_id"], by), earlier, ["set_id_prev1"], by)
    empty = F.array().cast("array<string>")
    return found.withColumns({c: F.coalesce(F.col(c), empty) for s in sets for c in (s, f"{s}_prev1")})


def triplets(
    ticks: DataFrame,
    settings: Settings = Settings(),
    segment_rows: int | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """``ordered_triplets`` with the texts of the sets; start values are zeros and empty sets."""
    rows, names = ordered_triplets(ticks, settings, segment_rows, before)
    return with_sets(rows, names, "tick").drop(*SET_IDS)


def last_two(ticks: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The last two snapshots of each cluster, by aggregation only, without ids of their sets."""
    ticks = ticks.drop("set_id")
    if before is not None:
        ticks = ticks.unionByName(before.select(*ticks.columns))
    row = F.struct(*ticks.columns).alias("t")
    last = ticks.groupBy("cluster").agg(F.max_by(row, "tick").alias("t"))
    ends = last.select("cluster", F.col("t.tick").alias("end"))
    earlier = ticks.join(ends, "cluster").where(F.col("tick") < F.col("end"))
    second = earlier.groupBy("cluster").agg(F.max_by(row, "tick").alias("t"))
    return last.unionByName(second).select("t.*")


def _complete_pairs(ticks: DataFrame, stride: int, segment_rows: int | None) -> DataFrame:
    """Drop malformed snapshots, and the first of a pair whose second one is malformed or yet to come.

    A failed tick of the first variant loses the snapshots it has read, and pairing starts anew.
    """
    if stride == 1:
        return ticks.where(~F.col("malformed")).drop("malformed")
    if stride != 2:
        raise ValueError("the first variant reads one or two snapshots per tick")
    good = F.when(F.col("malformed"), 0).otherwise(1)
    rows = scan(ticks, ["cluster"], "tick", sums={"good": good}, segment_rows=segment_rows)
    base = {"base": F.when(F.col("malformed"), F.col("good"))}
    rows = scan(rows, ["cluster"], "tick", lasts=base, segment_rows=segment_rows)
    rows = rows.withColumn("odd", (F.col("good") - F.coalesce("base", F.lit(0))) % 2 == 1)
    # Read backwards, the row before is the next snapshot.
    rows = rows.withColumns({"back": -F.col("tick"), "closes": ~F.col("odd") & ~F.col("malformed")})
    rows = scan(rows, ["cluster"], "back", lags={"next_closes": ("closes", 1)}, segment_rows=segment_rows)
    kept = rows.where(F.col("closes") | (~F.col("malformed") & F.coalesce("next_closes", F.lit(False))))
    return kept.drop("malformed", "good", "base", "odd", "back", "closes", "next_closes")
