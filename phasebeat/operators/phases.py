"""Phase of each tick, and how often the phase was visited before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.config import RESOURCES, Settings
from phasebeat.functions import phases as ph
from phasebeat.operators import ticks
from phasebeat.operators.ordered import scan, whole_part
from phasebeat.workspace import store


def phased(triplets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add similarity, change flag, phase text and its short id."""
    compared = "counted" if settings.variant == "v1" else "funcs"
    a, b = F.col(f"{compared}_prev1"), F.col(compared)
    return (
        triplets.withColumns(
            {"similarity": ph.similarity(a, b), "phase_changed": ph.changed(a, b, settings.threshold)}
        )
        .withColumn("phase", ph.phase_key(F.col("funcs_prev1"), F.col("funcs"), F.col("phase_changed")))
        .withColumn("phase_id", ph.phase_id(F.col("phase")))
    )


def named(
    snapshots: DataFrame,
    settings: Settings = Settings(),
    segment_rows: int | None = None,
    before: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Triplets with similarity, change flag, phase text and id, and the same per pair of sets.

    Ticks go through the windows with set ids.  Texts are looked up once for each pair of consecutive sets that occurs,
    and the phase of the pair is joined back.
    """
    rows, names = ticks.ordered_triplets(snapshots, settings, segment_rows, before)
    rows = store(rows, "triplets")
    pairs = ticks.with_sets(rows.select(*ticks.SET_IDS).distinct(), names, "set_id_prev1")
    pairs = phased(pairs, settings).select(*ticks.SET_IDS, "similarity", "phase_changed", "phase", "phase_id")
    pairs = store(pairs, "pairs")
    return ticks.join_written(rows, pairs, ticks.SET_IDS, "tick"), pairs


def phase_names(phased_ticks: DataFrame) -> DataFrame:
    """Dimension from short id to phase text."""
    return phased_ticks.select("phase_id", "phase").distinct()


def visits(
    phased_ticks: DataFrame,
    settings: Settings = Settings(),
    segment_rows: int | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """Number the visits of each phase; drop the texts.

    ``prior`` counts earlier visits that left a trace, ``seen`` says there was one, ``version``
    is the model trained last before this tick (0 = none).  Idle ticks leave no trace, nor does the first
    tick of the first variant.  ``before`` has the ``visits`` per phase of an earlier run.
    """
    idle = F.col("phase_id") == ph.phase_id(F.lit(ph.IDLE))
    counts = ~idle & (F.col("tick_no") > 1) if settings.variant == "v1" else ~idle
    values = [f"{r}{s}" for r in RESOURCES for s in ("_prev2", "_prev1", "")]
    rows = phased_ticks.select(
        "cluster", "tick", "tick_no", "phase_id", idle.alias("idle"), counts.alias("counts"), *values
    )
    one = F.col("counts").cast("long")
    rows = scan(rows, ["cluster", "phase_id"], "tick_no", sums={"upto": one}, segment_rows=segment_rows)
    prior = F.col("upto") - one
    if before is not None:
        rows = rows.join(before, ["cluster", "phase_id"], "left")
        prior = prior + F.coalesce("visits", F.lit(0))
    rows = rows.withColumn("prior", prior).drop("upto", "visits")
    version = F.when(F.col("idle"), F.lit(0)).otherwise(whole_part("prior", settings.cycle))
    return rows.withColumns({"seen": ~F.col("idle") & (F.col("prior") > 0), "version": version.cast("long")})


def visit_counts(visited: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Visits per phase so far, those of an earlier run included."""
    counts = visited.where("counts").select("cluster", "phase_id", (F.col("prior") + 1).alias("visits"))
    if before is not None:
        counts = counts.unionByName(before)
    return counts.groupBy("cluster", "phase_id").agg(F.max("visits").alias("visits"))


def known_phases(ticks: DataFrame, saved: DataFrame) -> DataFrame:
    """Ticks whose phase is in a saved phase table."""
    return ticks.join(saved.select("cluster", "phase_id").distinct(), ["cluster", "phase_id"], "left_semi")


def new_phases(ticks: DataFrame, saved: DataFrame) -> DataFrame:
    """Ticks whose phase is not in a saved phase table."""
    return ticks.join(saved.select("cluster", "phase_id").distinct(), ["cluster", "phase_id"], "left_anti")
