"""Lasso training with replay: each fit also sees synthetic points labelled by the model before.

The versions of one phase form a chain with three numbers of state per resource.  A chain is cut into segments, and all segments of
a task advance together: one step fits the next version of every segment as numpy columns, so Python runs once per step and not once
per row.  A first pass starts each segment cold, then every segment whose start differs from the end of the one before is folded
again from there, until all starts agree.  The result is exact.  Old models fade, so long segments need few repetitions: in a trial two
with 2,048 versions per segment, ten with 256.  What a pass has settled is not written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasebeat.config import RESOURCES, Settings
from phasebeat.functions.lasso import fit_many
from phasebeat.operators.ordered import whole_part
from phasebeat.workspace import store

SEGMENT = ["cluster", "phase_id", "segment"]
COEFFICIENTS = [f"{r}_{c}" for r in RESOURCES for c in ("w_prev2", "w_prev1", "intercept")]
STARTS = [f"start_{c}" for c in COEFFICIENTS]
# Rows of whole segments that a task advances together; a longer segment is taken alone.
TOGETHER = 1 << 15

# Fixed values of the seeded draw.
PRIME = 2147483647
VERSION_STEP, PLACE_STEP, RESOURCE_STEP, SEED_STEP = 7919, 104729, 1299709, 15485863
LOWEST, HIGHEST = 1, 99


def synthetic_value(phase_id: str, version: int, resource: int, place: int, seed: int) -> int:
    """A repeatable whole number in 1..99, the same in any engine with 64-bit integers."""
    u = int(phase_id[:8], 16) + VERSION_STEP * version + PLACE_STEP * place
    u = (u + RESOURCE_STEP * resource + SEED_STEP * seed) % PRIME
    return u * u % PRIME % HIGHEST + LOWEST


def synthetic_points(phase_id: str, version: int, resource: int, old: tuple, count: int, seed: int) -> list[tuple]:
    points = []
    for i in range(count):
        x1 = synthetic_value(phase_id, version, resource, 2 * i, seed)
        x2 = synthetic_value(phase_id, version, resource, 2 * i + 1, seed)
        points.append((x1, x2, old[0] * x1 + old[1] * x2 + old[2]))
    return points


def synthetic_columns(phases: np.ndarray, versions: np.ndarray, resource: int, count: int, seed: int) -> np.ndarray:
    """The features of the synthetic points of many models: ``phases`` is the number that the phase's id begins with."""
    places = np.arange(2 * count, dtype=np.int64)
    u = phases[:, None] + VERSION_STEP * versions[:, None] + PLACE_STEP * places
    u = (u + RESOURCE_STEP * resource + SEED_STEP * seed) % PRIME
    return (u * u % PRIME % HIGHEST + LOWEST).astype(float).reshape(len(phases), count, 2)


def _wavefront(rows: pd.DataFrame, first: np.ndarray, names: list, settings: Settings) -> np.ndarray:
    """The coefficients of every row; ``first`` are the places where a segment begins, in order."""
    replay, seed, alpha = settings.replay, settings.seed, settings.alpha
    lengths = np.diff(np.append(first, len(rows)))
    # Segments by falling length: those that go on are always the first ones.
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[order], lengths[order]
    phases = np.array([int(p[:8], 16) for p in rows["phase_id"].to_numpy()[begin]], np.int64)
    versions = rows["version"].to_numpy(np.int64)
    own = np.stack([rows[[c for place in of for c in place]].to_numpy(float).reshape(len(rows), -1, 3) for of in names])
    starts = rows[STARTS].to_numpy(float)[begin].reshape(len(begin), len(names), 3)
    out = np.empty((len(rows), len(names), 3))
    for step in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -step, side="left"))
        at = begin[:n] + step
        old = starts if step == 0 else out[at - 1]
        for k in range(len(names)):
            model, mine = old[:n, k], own[k, at]
            known = ~np.isnan(model[:, 0])
            if known.any():
                some = model[known]
                x = synthetic_columns(phases[:n][known], versions[at[known]], k, replay, seed)
                y = some[:, None, 0] * x[:, :, 0] + some[:, None, 1] * x[:, :, 1] + some[:, None, 2]
                out[at[known], k] = fit_many(np.concatenate([mine[known], np.dstack([x, y])], axis=1), alpha)
            if not known.all():
                out[at[~known], k] = fit_many(mine[~known], alpha)
    return out.reshape(len(rows), -1)


def _folder(settings: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [[[f"{r}_{p}_{i}" for p in ("prev2", "prev1", "curr")] for i in range(settings.batch_size)] for r in RESOURCES]

    def advanced(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        first = np.flatnonzero((rows[SEGMENT] != rows[SEGMENT].shift()).any(axis=1).to_numpy())
        out = rows[[*SEGMENT, "version"]].copy()
        out[COEFFICIENTS] = _wavefront(rows, first, names, settings)
        return out

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come in order; the last segment of what is held may go on in the next frame.
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            if sum(map(len, held)) >= TOGETHER:
                rows = pd.concat(held, ignore_index=True)
                last = rows[SEGMENT].iloc[-1]
                cut = int(np.flatnonzero((rows[SEGMENT] != last).any(axis=1).to_numpy()).max(initial=-1)) + 1
                if cut:
                    yield advanced([rows.iloc[:cut]])
                held = [rows.iloc[cut:]]
        if held:
            yield advanced(held)

    return fold


def _fold(rows: DataFrame, settings: Settings) -> DataFrame:
    ordered = rows.repartition(*SEGMENT).sortWithinPartitions(*SEGMENT, "version")
    schema = rows.select(*SEGMENT, "version", *STARTS).withColumnsRenamed(dict(zip(STARTS, COEFFICIENTS))).schema
    return ordered.mapInPandas(_folder(settings), schema)


def replayed_lasso(
    full: DataFrame, settings: Settings, previous: DataFrame | None = None, chain_rows: int | None = None
) -> DataFrame:
    """Coefficients per (cluster, phase, version) of the replayed chain.

    A chain goes on from the ``previous`` model of its phase, if there is one.
    """
    chain_rows = chain_rows or settings.chain_rows
    segment = whole_part("(version - 1)", chain_rows).alias("segment")
    rows = store(full.select("*", segment), "chains")
    if previous is None:
        first = rows.withColumns({s: F.lit(None).cast("double") for s in STARTS})
    else:
        old = [F.col(c).alias(s) for c, s in zip(COEFFICIENTS, STARTS)]
        following = whole_part("version", chain_rows).alias("segment")
        first = rows.join(previous.select("cluster", "phase_id", following, *old), SEGMENT, "left")
    keep = ["cluster", "phase_id", "version", *COEFFICIENTS]
    present = rows.select(*SEGMENT).distinct()
    passes = [store(_fold(first, settings), "models")]
    redone: list[DataFrame] = []
    used = None
    while True:
        # Only segments behind those of the last pass can have a new start.
        ends = passes[-1].groupBy(*SEGMENT).agg(F.max_by(F.struct(*COEFFICIENTS), "version").alias("e"))
        starts = ends.select(
            "cluster", "phase_id", (F.col("segment") + 1).alias("segment"),
            *[F.col(f"e.{c}").alias(s) for c, s in zip(COEFFICIENTS, STARTS)],
        ).join(present, SEGMENT, "left_semi")
        changed = starts if used is None else starts.join(used, [*SEGMENT, *STARTS], "left_anti")
        changed = store(changed, "starts")
        if changed.isEmpty():
            break
        redone.append(changed.select(*SEGMENT))
        passes.append(store(_fold(rows.join(changed, SEGMENT), settings), "models"))
        used = changed if used is None else store(
            used.join(changed, SEGMENT, "left_anti").unionByName(changed), "starts"
        )
    # Of each segment the last pass over it counts.
    result, later = passes[-1], None
    for one, again in zip(reversed(passes[:-1]), reversed(redone), strict=True):
        later = again if later is None else later.unionByName(again).distinct()
        result = result.unionByName(one.join(later, SEGMENT, "left_anti"))
    return result.select(*keep)
