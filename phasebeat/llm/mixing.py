"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p^a / sum p^a.  The exponent a is bisected until a repetition limit (or a
target entropy) is met, many candidates per pass over the table of sources.  Weights become token budgets, and a budget
is realised as block permutations: documents of a source are dealt to blocks, every epoch takes the blocks in a
new order, whole epochs take all of them, and the last one stops where the budget is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasebeat.llm.common import bucket, mark_of, n_words, text_of
from phasebeat.workspace import store

# Candidates of one bisection pass, and passes: the exponent is found to 32^-5.
CANDIDATES = 32
PASSES = 5
# The running sums of a source are taken over so many parts first, so that no source is summed in one task.
SLICES = 64


def _search(sources: DataFrame, met: Column, low_is_met: bool) -> float:
    """The boundary in [0, 1] between exponents that meet a target and those that do not."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * k / CANDIDATES for k in range(CANDIDATES + 1)]
        tried = sources.select("share", F.explode(F.array(*[F.lit(a) for a in grid])).alias("a"))
        power = F.pow("share", F.col("a"))
        least = F.min_by(power / F.col("share"), F.col("share")).alias("most")
        sums = tried.groupBy("a").agg(
            F.sum(power).alias("z"),
            F.sum(power * F.col("a") * F.log("share")).alias("slope"),
            least,
            F.min_by(power / F.col("share"), -F.col("share")).alias("base"),
            F.count("*").alias("n"),
        )
        good = {r["a"]: bool(r["ok"]) for r in sums.select("a", met.alias("ok")).collect()}
        inside = [a for a in grid if good.get(a)]
        if low_is_met:  # small exponents meet it: the largest of them
            low = max(inside, default=low)
            high = min((a for a in grid if a > low), default=high)
        else:  # large exponents meet it: the smallest of them
            high = min(inside, default=high)
            low = max((a for a in grid if a < high), default=low)
    return low if low_is_met else high


def exponent_for_repetition(sources: DataFrame, limit: float) -> float:
    """The smallest exponent with which no source is repeated over ``limit`` times when the largest is taken once."""
    return _search(sources, F.col("most") <= F.lit(limit) * F.col("base"), low_is_met=False)


def exponent_for_entropy(sources: DataFrame, part: float) -> float:
    """The largest exponent with which the weights' entropy is at least ``part`` of the logarithm of the number of sources."""
    entropy = F.log("z") - F.col("slope") / F.col("z")
    return _search(sources, entropy >= F.lit(part) * F.log("n") - F.lit(1e-12), low_is_met=True)


def exponent_midway(sources: DataFrame, limit: float = 2.0) -> float:
    """The largest exponent whose entropy is halfway from that of the shares to its maximum, or the repetition limit's if that is larger."""
    entropy = F.sum(-F.col("share") * F.log("share"))
    row = sources.agg(F.count("*").alias("n"), entropy.alias("entropy")).first()
    part = (row["entropy"] / math.log(row["n"]) + 1) / 2 if row["n"] > 1 else 1.0
    return max(exponent_for_entropy(sources, part), exponent_for_repetition(sources, limit))


def source_shares(rows: DataFrame) -> DataFrame:
    """``source, tokens, share`` of each source with tokens; ``rows`` has ``source`` and ``tokens``."""
    by = rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    whole = by.agg(F.sum("tokens").alias("whole"))
    total = whole.first()["whole"] or 1
    return by.withColumn("share", F.col("tokens") / F.lit(float(total)))


def mixture(
    docs: DataFrame,
    repetition: float | None = None,
    entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = 32_768,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every draw of the mixture: ``doc_id, source, tokens, epoch, block, weight, exponent, mix_key, mark`` and ``keep``.

    The target is the ``entropy`` (as a part of its maximum) or else the limit of ``repetition``; without either it is the entropy halfway
    between that of the shares and its maximum, with no source repeated over twice.  Tokens are words.  ``budget`` is the number of tokens to draw; by default it is just large enough that every source
    is taken once or more, so no document is left out.  Sorting by ``mix_key`` (0 to 1) gives the training order,
    in which all sources advance at the rate of their weights.

    A null source is a source of its own.  Documents without words belong to epoch 0 and cost nothing.  Repeated rows
    are drawn separately.  A document that crosses the end of the budget is still drawn.  An empty table gives no rows.
    """
    text = text_of(docs)
    named = F.concat(F.lit("="), F.col("source").cast("string"))
    key = F.coalesce(named, F.lit("")).alias("source")
    mark = mark_of(docs).alias("mark")
    kept = [F.col(f"`{c}`").alias(f"_{c}") for c in keep]
    rows = store(docs.select("doc_id", key, n_words(text).alias("tokens"), mark, *kept), "draws")
    sources = store(source_shares(rows), "sources")
    if entropy is not None:
        exponent = exponent_for_entropy(sources, entropy)
    elif repetition is not None:
        exponent = exponent_for_repetition(sources, repetition)
    else:
        exponent = exponent_midway(sources)
    power = F.pow("share", F.lit(exponent))
    z = sources.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("fit")).first()
    drawn = float(budget) if budget is not None else (z["fit"] or 0.0) * (z["z"] or 0.0)
    weight = power / F.lit(z["z"] or 1.0)
    n_blocks = F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("int")
    # A hair is taken off, so that a source that is taken once exactly does not start a second epoch.
    epochs = F.col("weight") * F.lit(drawn) / F.col("tokens") * F.lit(1 - 1e-9)
    plan = sources.withColumn("weight", weight).withColumns({"n_blocks": n_blocks, "epochs": F.ceil(epochs).cast("int")})
    plan = plan.select("source", "weight", "n_blocks", "epochs", (F.col("weight") * F.lit(drawn)).alias("budget"))

    with_plan = rows.join(plan, "source", "left").withColumns(
        {"n_blocks": F.coalesce("n_blocks", F.lit(1)), "epochs": F.greatest(F.coalesce("epochs", F.lit(1)), F.lit(1))}
    )
    in_blocks = with_plan.withColumn("block", bucket(F.xxhash64("doc_id", "mark"), F.col("n_blocks"), seed))
    blocks = in_blocks.groupBy("source", "block").agg(
        F.sum("tokens").alias("tokens"), F.first("epochs").alias("epochs"), F.first("budget").alias("budget")
    )
    order = F.xxhash64(F.lit(seed), "source", "epoch", "block")
    taken = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    part = F.shiftrightunsigned(order, 58).cast("int")  # the high bits: parts follow one another in the order
    taken = store(taken.withColumns({"order": order, "part": F.pmod(part, F.lit(SLICES))}), "blocks")
    sums = taken.groupBy("source", "epoch", "part").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "epoch", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    unsigned = Window.partitionBy("source", "epoch", "part").orderBy("order", "block")
    ahead = F.coalesce(F.sum("tokens").over(unsigned.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = taken.withColumn("ahead", ahead).join(starts, ["source", "epoch", "part"])
    placed = placed.select(
        "source", "epoch", "block", (F.col("base") + F.col("ahead")).alias("start"), F.col("tokens").alias("block_sum")
    )
    chosen = placed.join(plan.select("source", "budget"), "source", "left")
    chosen = chosen.where(F.col("budget").isNull() | (F.col("start") < F.col("budget")))
    draws = in_blocks.drop("epochs", "n_blocks", "budget").join(chosen, ["source", "block"])
    # Whole blocks are taken as they are; only in the block that the budget ends in do single documents count.
    whole = F.col("budget").isNull() | (F.col("start") + F.col("block_sum") <= F.col("budget") * F.lit(1 + 1e-9))
    inner = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64("doc_id", "mark", "epoch"), "doc_id", "mark")
    ends = draws.where(~whole).withColumn(
        "inside", F.coalesce(F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ends = ends.where(F.col("start") + F.col("inside") < F.col("budget")).drop("inside")
    result = draws.where(whole).unionByName(ends)
    return result.select(
        "doc_id",
        F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source"),
        "tokens",
        "epoch",
        "block",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.lit(exponent).alias("exponent"),
        F.coalesce(F.least(F.col("start") / F.col("budget"), F.lit(1.0)), F.lit(0.0)).alias("mix_key"),
        "mark",
        *[F.col(f"`_{c}`").alias(c) for c in keep],
    )
