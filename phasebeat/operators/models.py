"""Per phase and resource: batches of profiles, models trained from them, predictions.

Which model a visit sees depends only on its number within the phase, so training is one
aggregation by (cluster, phase, version) and looking a model up is an equi-join on the same
key.  A group never holds more rows than a batch, so no phase can be a hot key.
"""

from __future__ import annotations

from functools import reduce
from math import floor, log10
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phasebeat.config import RESOURCES, Settings
from phasebeat.functions.lasso import with_lasso
from phasebeat.operators.ordered import whole_part
from phasebeat.operators.replay import replayed_lasso
from phasebeat.workspace import store

KEY = ["cluster", "phase_id", "version"]
PARTS = ("prev2", "prev1", "curr")


def _visit_column(resource: str, part: str) -> str:
    return resource if part == "curr" else f"{resource}_{part}"


def profiles(visits: DataFrame) -> DataFrame:
    """Stored profiles, one row per visit and resource."""
    rows = visits.where("counts").select("cluster", "phase_id", (F.col("prior") + 1).alias("visit_no"), *[
        F.col(_visit_column(r, p)).alias(f"{r}_{p}") for r in RESOURCES for p in PARTS
    ])
    return _by_resource(rows, ["cluster", "phase_id", "visit_no"], PARTS, ("x_prev2", "x_prev1", "y"))


def _by_resource(rows: DataFrame, keys: list[str], parts: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """One row per resource from columns named ``<resource>_<part>``."""
    entries = [
        F.struct(F.lit(r).alias("resource"), *[F.col(f"{r}_{p}").alias(n) for p, n in zip(parts, names)])
        for r in RESOURCES
    ]
    return rows.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def batches(visits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Full training batches, one row per (cluster, phase, version).

    ``<resource>_<part>_<i>`` holds the i-th profile.  Values are placed, not added, so the result does
    not depend on the order in which partitions arrive.
    """
    pos = F.col("prior") % settings.cycle
    rows = visits.where("counts").select(
        "cluster",
        "phase_id",
        (whole_part("prior", settings.cycle) + 1).alias("version"),
        pos.alias("pos"),
        *{_visit_column(r, p) for r in RESOURCES for p in PARTS},
    )
    placed = [
        F.expr(f"max(CASE WHEN pos = {i} THEN {_visit_column(r, p)} END) AS {r}_{p}_{i}")
        for r in RESOURCES
        for p in PARTS
        for i in range(settings.batch_size)
    ]
    full = rows.groupBy(*KEY).agg(F.count("*").alias("members"), *placed)
    return full.where(F.col("members") == settings.cycle).drop("members")


def with_pending(visits: DataFrame, pending: DataFrame | None) -> DataFrame:
    """Visits together with those an earlier run stored without training."""
    return visits if pending is None else visits.unionByName(pending.select(*visits.columns))


def pending_visits(visits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Visits whose profiles were stored since the last training of their phase."""
    done = batches(visits, settings).select("cluster", "phase_id", F.col("version").alias("batch"))
    rows = visits.where("counts").where(F.col("prior") % settings.cycle < settings.batch_size)
    rows = rows.withColumn("batch", whole_part("prior", settings.cycle) + 1)
    return rows.join(done, ["cluster", "phase_id", "batch"], "left_anti").select(*visits.columns)


def pending_profiles(visits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Profiles stored since the last training of their phase."""
    return profiles(pending_visits(visits, settings))


def batch_statistics(full: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Sums that determine the regression of a batch, one row per resource."""
    n = range(settings.batch_size)
    sums = {}
    for r in RESOURCES:
        x1, x2, y = ([F.col(f"{r}_{p}_{i}") for i in n] for p in PARTS)
        for name, u, v in (
            ("sum_x1", x1, None), ("sum_x2", x2, None), ("sum_y", y, None),
            ("sum_x1x1", x1, x1), ("sum_x1x2", x1, x2), ("sum_x2x2", x2, x2),
            ("sum_x1y", x1, y), ("sum_x2y", x2, y),
        ):
            sums[f"{r}_{name}"] = reduce(add, [p if v is None else p * v[i] for i, p in enumerate(u)])
    names = tuple(k.split("_", 1)[1] for k in sums if k.startswith(f"{RESOURCES[0]}_"))
    rows = full.select(*KEY, *[c.alias(k) for k, c in sums.items()])
    return _by_resource(rows, KEY, names, names).withColumn("n", F.lit(settings.batch_size).cast("long"))


def lasso_models(full: DataFrame, settings: Settings = Settings(), previous: DataFrame | None = None) -> DataFrame:
    """Coefficients per (cluster, phase, version), wide over resources.

    With ``replay`` points each fit also sees that many synthetic points labelled by the model before,
    which makes the versions of a phase a chain.  ``previous`` models are those of an earlier run.
    """
    if settings.replay:
        return replayed_lasso(full, settings, previous)
    points = {
        r: [tuple(f"{r}_{p}_{i}" for p in PARTS) for i in range(settings.batch_size)] for r in RESOURCES
    }
    return with_lasso(full, points, settings.alpha).select(*KEY, *coefficient_names())


def coefficient_names() -> list[str]:
    return [f"{r}_{c}" for r in RESOURCES for c in ("w_prev2", "w_prev1", "intercept")]


def models_by_resource(models: DataFrame, settings: Settings = Settings()) -> DataFrame:
    parts = ("w_prev2", "w_prev1", "intercept")
    return _by_resource(models, KEY, parts, parts).withColumn("n", F.lit(settings.batch_size).cast("long"))


def agg_models(full: DataFrame, settings: Settings = Settings(), previous: DataFrame | None = None) -> DataFrame:
    """Running mean per resource: the new one is the mean of the batch inputs and the old one.

    ``m_v = (S_v + m_(v-1)) / b`` is a sum of inputs with weights ``b^-k``.  Versions are cut into
    segments short enough for ``b^k`` to stay finite; what a segment inherits from the two before it
    is added through a join with one row per full segment.  Older ones weigh less than the
    smallest double.
    """
    b = float(2 * settings.batch_size + 1)
    length = floor(200 / log10(b))
    inputs = {
        r: reduce(add, [F.col(f"{r}_{p}_{i}") for i in range(settings.batch_size) for p in ("prev2", "prev1")])
        for r in RESOURCES
    }
    place = (F.col("version") - 1) % length
    rows = full.select(
        *KEY, place.alias("place"), whole_part("(version - 1)", length).alias("segment"),
        *[(s * F.pow(F.lit(b), place)).alias(r) for r, s in inputs.items()],
    )
    rows = store(rows, "batch_inputs")
    chain = ["cluster", "phase_id", "segment"]
    upto = W.partitionBy(*chain).orderBy("version").rowsBetween(W.unboundedPreceding, W.currentRow)
    shrink = F.pow(F.lit(b), F.col("place") + 1)
    joined = rows.withColumns({r: F.sum(r).over(upto) / shrink for r in RESOURCES})
    means = {r: F.col(r) for r in RESOURCES}
    joined = joined.join(_inherited(rows, chain, b, length), chain, "left")
    means = {r: m + F.coalesce(F.col(f"start_{r}"), F.lit(0.0)) / shrink for r, m in means.items()}
    if previous is not None:
        old = [F.col("version").alias("old_version"), *[F.col(f"{r}_mean").alias(f"old_{r}") for r in RESOURCES]]
        joined = joined.join(previous.select("cluster", "phase_id", *old), ["cluster", "phase_id"], "left")
        fade = F.pow(F.lit(b), F.col("old_version") - F.col("version"))
        means = {r: m + F.coalesce(F.col(f"old_{r}") * fade, F.lit(0.0)) for r, m in means.items()}
    return joined.select(*KEY, *[m.alias(f"{r}_mean") for r, m in means.items()])


def _inherited(rows: DataFrame, chain: list[str], b: float, length: int) -> DataFrame:
    """What each segment starts from: the ends of the two full segments before it."""
    ends = rows.groupBy(*chain).agg(*[(F.sum(r) / F.lit(b**length)).alias(r) for r in RESOURCES])
    shares = [
        F.struct(
            (F.col("segment") + 1 + late).alias("segment"),
            *[(F.col(r) / F.lit(b ** (late * length))).alias(f"start_{r}") for r in RESOURCES],
        )
        for late in (0, 1)
    ]
    rest = [c for c in chain if c != "segment"]
    passed = ends.select(*rest, F.explode(F.array(*shares)).alias("e")).select(*rest, "e.*")
    return passed.groupBy(*chain).agg(*[F.sum(f"start_{r}").alias(f"start_{r}") for r in RESOURCES])


def train(
    visits: DataFrame,
    settings: Settings = Settings(),
    pending: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> DataFrame | None:
    """Models of the chosen algorithm; ``None`` where the algorithm keeps none.

    ``pending`` visits and ``previous`` models are those of an earlier run; its models are kept.
    """
    full = batches(with_pending(visits, pending), settings)
    if settings.algo == "lasso":
        trained = lasso_models(full, settings, previous)
    elif settings.algo == "agg" and settings.variant == "v1":
        trained = agg_models(full, settings, previous)
    else:
        return None
    return trained if previous is None else trained.unionByName(previous.select(*trained.columns))


def linear(resource: str) -> Column:
    return (
        F.col(f"{resource}_w_prev2") * F.col(f"{resource}_prev2")
        + F.col(f"{resource}_w_prev1") * F.col(f"{resource}_prev1")
        + F.col(f"{resource}_intercept")
    )


def predict(visits: DataFrame, models: DataFrame | None, settings: Settings = Settings()) -> DataFrame:
    """Add ``predicted_<resource>``: zeros when idle, the model in force if there is one, else the value before."""
    naive = {r: F.col(f"{r}_prev1") for r in RESOURCES}
    if models is None:
        chosen, rows = naive, visits
    else:
        # Ticks without a model get a key of their own, so that they spread over all tasks.
        has_model = F.col("version") > 0
        rows = visits.withColumn("model_key", F.when(has_model, F.col("version")).otherwise(-F.col("tick_no")))
        found = models.withColumnRenamed("version", "model_key")
        rows = rows.join(found.hint("merge"), ["cluster", "phase_id", "model_key"], "left").drop("model_key")
        if settings.algo == "agg":
            trained = reduce(lambda p, q: p | q, [F.col(f"{r}_mean") != 0 for r in RESOURCES])
            chosen = {r: F.when(trained, F.col(f"{r}_mean")).otherwise(naive[r]) for r in RESOURCES}
        else:
            chosen = {r: F.coalesce(linear(r), naive[r]) for r in RESOURCES}
    predicted = {f"predicted_{r}": F.when(F.col("idle"), F.lit(0.0)).otherwise(c) for r, c in chosen.items()}
    extra = [] if models is None else [c for c in models.columns if c not in KEY]
    return rows.withColumns(predicted).drop(*extra)
