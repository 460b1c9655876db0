"""The whole analysis over recorded samples: ticks, phases, models, predictions, anomalies."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasebeat.config import Settings
from phasebeat.operators import anomaly, models, phases, ticks
from phasebeat.sources import tables
from phasebeat.workspace import store, stored


@dataclass(frozen=True)
class Saved:
    """What a stopped run leaves for the next one; the confidence is not part of it."""

    snapshots: DataFrame
    counts: DataFrame
    pending: DataFrame
    models: DataFrame | None

    def save(self, root: str, version: int) -> None:
        found = {n: getattr(self, n) for n in ("snapshots", "counts", "pending", "models")}
        tables.save_phases(root, version, **{n: t for n, t in found.items() if t is not None})

    @staticmethod
    def load(spark: SparkSession, root: str, version: int) -> Saved | None:
        found = {n: tables.load_phases(spark, root, version, n) for n in ("snapshots", "counts", "pending", "models")}
        return None if found["counts"] is None else Saved(**found)


@dataclass(frozen=True)
class Watch:
    """Tables of one analysis; ``models`` is ``None`` for an algorithm that keeps none."""

    ticks: DataFrame
    phases: DataFrame
    visits: DataFrame
    models: DataFrame | None
    scored: DataFrame
    settings: Settings
    before: Saved | None

    def state(self) -> Saved:
        """The last two snapshots, visits and pending profiles per phase, and the newest models."""
        s, key = self.settings, ["cluster", "phase_id"]
        counts = phases.visit_counts(self.visits, self.before.counts if self.before else None)
        pending = models.pending_visits(models.with_pending(self.visits, self.before and self.before.pending), s)
        newest = None
        if self.models is not None:
            rest = [c for c in self.models.columns if c not in key]
            newest = self.models.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("m")).select(*key, "m.*")
        return Saved(ticks.last_two(self.ticks, self.before and self.before.snapshots), counts, pending, newest)


def visited(
    samples: DataFrame, expected: DataFrame, settings: Settings = Settings(), empty_function: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, int | None]:
    """Ticks, phased triplets and numbered visits, and the segment length they needed.

    Raw samples are read once, for the ticks; ticks and visits are written, since several later
    steps read each of them.
    """
    snapshots, cut = _snapshots(samples, expected, settings, empty_function)
    named, _, numbered = _visited(snapshots, settings, cut, None)
    return snapshots, named, numbered, cut


def visited_ticks(snapshots: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Numbered visits from cluster snapshots on."""
    return _visited(stored(snapshots, "ticks"), settings, settings.segment_rows, None)[2]


def _snapshots(
    samples: DataFrame, expected: DataFrame, settings: Settings, empty_function: bool
) -> tuple[DataFrame, int | None]:
    cut = settings.segment_rows
    return store(ticks.cluster_ticks(samples, expected, settings, cut, empty_function), "ticks"), cut


def _visited(
    snapshots: DataFrame, settings: Settings, cut: int | None, before: Saved | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    # The first variant does not keep snapshots over a stop.
    last = before.snapshots if before and settings.variant == "v2" else None
    named, pairs = phases.named(snapshots, settings, cut, last)
    numbered = phases.visits(named, settings, cut, before.counts if before else None)
    return named, pairs, store(numbered, "visits")


def watch(
    samples: DataFrame,
    expected: DataFrame,
    settings: Settings = Settings(),
    stop_at_first: bool = False,
    empty_function: bool = False,
    start_confidence: int = 0,
    before: Saved | None = None,
    missing_ends: bool = False,
) -> Watch:
    """Analyse samples with an integer ``tick`` per cluster and worker, going on from ``before`` if given.

    With ``missing_ends`` a cluster ends at the first tick in which a configured worker is missing.  That tick is an alert without
    a number, a phase or a confidence, and nothing is learnt from it; a cluster that ``stop_at_first`` has ended before has none.
    """
    ends = None
    if missing_ends:
        ends = store(ticks.missing_ends(samples, expected), "ends")
        samples = samples.join(ends, "cluster", "left").where("end IS NULL OR tick < end").drop("end")
    snapshots, _ = _snapshots(samples, expected, settings, empty_function)
    found = watch_ticks(snapshots, settings, stop_at_first, start_confidence, before)
    if ends is None:
        return found
    if stop_at_first:
        ends = ends.join(found.scored.where("alert").select("cluster").distinct(), "cluster", "left_anti")
    last = ends.select("cluster", F.col("end").alias("tick"), F.lit(True).alias("alert"))
    return replace(found, scored=found.scored.unionByName(last, allowMissingColumns=True))


def watch_ticks(
    snapshots: DataFrame,
    settings: Settings = Settings(),
    stop_at_first: bool = False,
    start_confidence: int = 0,
    before: Saved | None = None,
) -> Watch:
    """The same from cluster snapshots on."""
    snapshots = stored(snapshots, "ticks")
    cut = settings.segment_rows
    _, pairs, numbered = _visited(snapshots, settings, cut, before)
    trained = models.train(numbered, settings, before.pending if before else None, before.models if before else None)
    predictions = models.predict(numbered, trained, settings)
    scored = anomaly.scored(predictions, settings, cut, stop_at_first, start_confidence)
    return Watch(snapshots, phases.phase_names(pairs), numbered, trained, scored, settings, before)
