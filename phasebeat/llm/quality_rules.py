"""Quality rules: a table of thresholds compiled into one projection.

Metrics are column expressions over the text, a rule is a metric with a lowest and a highest value, and the
verdict is their conjunction.  Everything is built-in functions; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.common import WORD, text_of

# Blanks, symbols and windows of the query contract.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED_PERCENT = 30

# Frequent function words of the languages that are judged.
STOP_WORDS = (
    "the and of to in is that for with was a it on as be by this are at or from",
    "der die und das den dem ein eine nicht mit von zu im ist auf sich auch als für es",
    "le la les de des et que un une dans en est pour sur par qui au du il ne",
    "el los las de que y en un una por con para del se no es al lo su como",
)


@dataclass(frozen=True)
class Rule:
    """A metric that a kept text has between ``low`` and ``high``, both included; ``None`` is no bound."""

    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.col(self.metric)
        tests = [value >= F.lit(self.low)] if self.low is not None else []
        tests += [value <= F.lit(self.high)] if self.high is not None else []
        met = F.lit(True)
        for test in tests:
            met = met & test
        return F.coalesce(met, F.lit(False))


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", high=0.3),
    Rule("marks_per_word", high=0.8),
    Rule("upper_ratio", high=0.6),
    Rule("dup_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.02),
)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of eight which the text has twice or more, first occurrences included."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        return F.when(F.size(w) < WINDOW, 0).otherwise(_bound(hashes, repeats))

    def repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bound(pairs, covered))

    def covered(p: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))

        return _bound(F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"])), length)

    def length(at: Column) -> Column:
        # Each window counts up to the start of the next one.
        parts = F.transform(at, lambda a, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - a), F.lit(WINDOW)))
        return F.aggregate(parts, F.lit(0), lambda n, x: n + x)

    return _bound(words, of).cast("long")


def metrics(text: Column) -> dict[str, Column]:
    """The counts that rules and results are made of."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: _without(x, BLANKS) > 0)
    stop = sorted({w for group in STOP_WORDS for w in group.split()})
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": _without(text, BLANKS).cast("long"),
        "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("long"),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda x: F.lower(x).isin(stop))).cast("long"),
        "n_upper": (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
        "n_marks": (F.length(text) - _without(text, "!")).cast("long"),
    }


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the counts, the ratios, ``base_failed`` and ``kept`` of every row.

    A text with fewer than 20 words, or with over 30 % of them in repeated windows, fails; any other is kept if it meets all rules.
    Null texts count as empty and fail.  Repeated rows are judged one by one; an empty table gives no rows.
    """
    counted = docs.select("doc_id", text_of(docs).alias("text"))
    counted = counted.select("doc_id", *[c.alias(n) for n, c in metrics(F.col("text")).items()])
    word = F.greatest(F.col("n_words"), F.lit(1))
    char = F.greatest(F.col("word_chars"), F.lit(1))
    line = F.greatest(F.col("n_lines"), F.lit(1))
    ratios = {
        "mean_word_chars": F.col("word_chars") / word,
        "symbols_per_word": F.col("n_symbols") / word,
        "marks_per_word": F.col("n_marks") / word,
        "upper_ratio": F.col("n_upper") / char,
        "dup_line_ratio": F.col("n_dup_lines") / line,
        "ellipsis_line_ratio": F.col("n_ellipsis_lines") / line,
        "stop_word_ratio": F.col("n_stop_words") / word,
    }
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    verdict = ~F.col("base_failed")
    for rule in rules:
        verdict = verdict & rule.holds()
    return counted.withColumns(ratios | {"base_failed": failed}).withColumn("kept", verdict)
