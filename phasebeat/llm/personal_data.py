"""Personal data by rules and by bootstrapped context patterns, in DataFrame functions only.

Rules find e-mail addresses, network addresses, card and phone numbers.  These are the seeds, together with tokens that have the
shape of a key: long, of letters and digits that change often.  The words next to a seed, one on either side and the two before it, are
lexical patterns of it, and every token with digits is an instance that patterns may reach.  Patterns and instances form a
graph that is scored in rounds: a pattern by the part of its instances that are trusted, an instance by its patterns.
A pattern is trusted too if most of its instances are seeds, and far more than beside other words: instances that no rule knows are
what it is to find, and do not count against it.
Tokens next to high-scored patterns are added with the kind ``other``, as are the tokens with the shape of a key; what the rules
found stays.

Positions come from splitting a text at the matches of a pattern and summing lengths, so there is one row per match and
no state per document beyond a window over its own matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasebeat.llm.common import mark_of, text_of
from phasebeat.workspace import store

# Kinds and patterns of the query contract.  Quantifiers are possessive and runs are entered at their start or after
# the last match (\G), which changes no match but keeps the search linear.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # Tokens with a digit, the instances that context patterns may reach.
    "other": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+",
}
KINDS = list(PATTERNS)
# What a text must contain for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "other": None}
EDGE = """"'()[]{},.;:!?*$%&#<>|="""
# The shape of a key: its characters, and how often a letter follows a digit at least.
KEY = r"^[A-Za-z0-9_-]{20,128}$"
CHANGES = 4

# Bounds of the bootstrap: context length in characters, length and digits of an instance, instances that a pattern must
# have reached, the score from which patterns and instances are trusted, rounds.
CONTEXT = 32
LEAST_CHARS, LEAST_DIGITS = 6, 4
SUPPORT = 8
TRUST = 0.9
ROUNDS = 3
# Share of seeds from which a pattern may be trusted for its lift, and the lift: nats by which the share would be a surprise
# if seeds were as frequent beside the pattern as elsewhere.
MOST = 0.5
LIFT = 16.0

ROW = ["doc_id", "mark"]


def _pieces(docs: DataFrame) -> DataFrame:
    """One row per match of any pattern: its number, the length of the gap before it, and the words next to it."""
    text = F.col("text")
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        may = text.rlike("[0-9]") if NEEDS[kind] is None else text.contains(NEEDS[kind])
        matches = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        found.append(F.struct(F.lit(number).alias("kind"), F.lit(pattern).alias("pattern"), matches.alias("matches")))
    rows = docs.select("doc_id", mark_of(docs).alias("mark"), text_of(docs).alias("text"))
    by_kind = rows.select(*ROW, "text", F.explode(F.array(*found)).alias("f")).where(F.size("f.matches") > 0)
    gaps = F.split(text, F.col("f.pattern"), -1)
    before = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("left")))
    after = F.transform(F.slice(gaps, F.lit(2), F.size("f.matches")), lambda g: F.left(g, F.lit(CONTEXT)))
    zipped = F.arrays_zip(F.col("f.matches").alias("match"), before.alias("before"), after.alias("right"))
    listed = by_kind.select(*ROW, F.col("f.kind").alias("kind"), F.size("f.matches").alias("n"), zipped.alias("z"))
    one = listed.select(*ROW, "kind", "n", F.posexplode("z").alias("k", "p")).where("k < n")
    return one.select(*ROW, "kind", "k", "p.match", "p.before.gap", F.col("p.before.left").alias("left"), "p.right")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of up to 19 digits is right."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(k: Column) -> Column:
        digit = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(k % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda x: (F.length(x) < 4) & (F.coalesce(F.left(x, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == KINDS.index("email"), F.lit(True))
        .when(kind == KINDS.index("ip"), small)
        .when(kind == KINDS.index("card"), F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == KINDS.index("phone"), n.between(8, 15))
        .otherwise((F.length(match) >= LEAST_CHARS) & (n >= LEAST_DIGITS))
    )


def matches(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, kind, start, stop, match, left, right, pair`` of base matches, and of tokens with digits that touch none.

    Positions are in code points, the end exclusive; ``left`` and ``right`` are the neighbouring words, ``pair`` the two on the left.
    """
    # Rows that share id and text are one here; their matches are the same.
    pieces = store(_pieces(docs), "pieces").dropDuplicates([*ROW, "kind", "k"])
    so_far = Window.partitionBy(*ROW, "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.length("match")).over(so_far)
    placed = pieces.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("match")).drop("gap", "k")
    # Tokens lose the punctuation around them.
    other = F.col("kind") == KINDS.index("other")
    head = F.length("match") - F.length(F.ltrim(F.col("match"), F.lit(EDGE)))
    core = F.btrim(F.col("match"), F.lit(EDGE))
    trimmed = placed.withColumns({"start": F.when(other, F.col("start") + head).otherwise(F.col("start")), "match": F.when(other, core).otherwise(F.col("match"))})
    trimmed = trimmed.withColumn("stop", F.col("start") + F.length("match")).where(_valid(F.col("kind"), F.col("match")))
    # A token that touches a base match is part of it.
    by_start = Window.partitionBy(*ROW).orderBy("start", "kind")
    base = F.col("kind") < KINDS.index("other")
    reached = F.max(F.when(base, F.col("stop"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    touched = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("stop"), F.lit(False))
    apart = trimmed.withColumn("touched", touched).where(base | ~F.col("touched")).drop("touched")
    words = F.filter(F.split(F.lower("left"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))
    left = F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit(""))
    pair = F.when(F.size(last) == 2, F.array_join(last, " ")).otherwise("")
    right = F.lower(F.regexp_extract("right", r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1))
    return apart.withColumns({"left": left, "right": right, "pair": pair})


def is_seed() -> Column:
    """Whether a row of ``matches`` is a seed: a base match, or a token with the shape of a key."""
    changes = F.regexp_count("match", F.lit("[0-9][A-Za-z]"))
    return (F.col("kind") < KINDS.index("other")) | (F.col("match").rlike(KEY) & (changes >= CHANGES))


SIDES = ("left", "right", "pair")


def _patterns() -> Column:
    """The lexical patterns of a row of ``matches``."""
    return F.array_compact(F.array(*[F.when(F.col(side) != "", F.concat(F.lit(f"{side}="), F.col(side))) for side in SIDES]))


def _lift(n: Column, seeds: Column, rest: Column) -> Column:
    """Chernoff's bound, in nats, of ``seeds`` or more among ``n`` instances where a share ``rest`` of all others are seeds."""
    share = seeds / n
    unseen = F.when(seeds < n, (1 - share) * F.log((1 - share) / (1 - rest))).otherwise(F.lit(0.0))
    return F.when(share > rest, n * (share * F.log(share / rest) + unseen)).otherwise(F.lit(0.0))


def trusted_patterns(found: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, score`` of the context patterns that are trusted after the last round.

    ``found`` is what ``matches`` returns.  A pattern's score is the trusted weight of its distinct instances over their number plus
    one; an instance that no rule has found gets the noisy-or of its trusted patterns' scores.  A pattern is trusted for its
    score, or for its lift: instances that no rule has found are neutral there as long as seeds are the larger part.
    """
    edges = found.select("match", is_seed().alias("seed"), F.explode(_patterns()).alias("pattern"))
    edges = store(edges.groupBy("pattern", "match").agg(F.max(F.col("seed").cast("double")).alias("score")), "graph")
    total = edges.agg(F.count("*").alias("n"), F.sum("score").alias("seeds")).first()

    def trusted(weighed: DataFrame, value: Column) -> DataFrame:
        patterns = weighed.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("score").alias("seeds"), F.sum(value).alias("weight"))
        scored = patterns.withColumn("score", F.col("weight") / (F.col("n") + 1))
        n, seeds = F.col("n"), F.col("seeds")
        rest = (F.lit(total["seeds"] or 0.0) - seeds + 1) / (F.lit(total["n"]) - n + 2)
        lifted = (seeds / (n + 1) >= MOST) & (_lift(n, seeds, rest) >= LIFT)
        return scored.where((n >= support) & ((F.col("score") >= trust) | lifted)).select("pattern", "score")

    good = trusted(edges, F.col("score"))
    for _ in range(rounds - 1):
        good = store(good, "patterns")
        reached = edges.join(good.withColumnRenamed("score", "p"), "pattern")
        doubt = F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999999)))))
        instances = reached.groupBy("match").agg((1 - doubt).alias("gained"))
        weighed = edges.join(instances, "match", "left")
        good = trusted(weighed, F.greatest("score", F.coalesce("gained", F.lit(0.0))))
    return store(good, "patterns")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other, n_spans, mark`` of every row.

    ``spans`` lists ``kind:start:end``, by kind, then start.  Null texts count as empty and have no spans, repeated rows all get
    theirs, an empty table gives no rows.  A text without matches has the digest of the empty string.
    """
    found = store(matches(docs), "matches")
    good = trusted_patterns(found)
    tokens = found.where(F.col("kind") == KINDS.index("other"))
    reach = tokens.select(*ROW, "kind", "start", "stop", F.explode(_patterns()).alias("pattern"))
    keys = tokens.where(is_seed()).select(*ROW, "kind", "start", "stop")
    added = reach.join(good.select("pattern"), "pattern", "left_semi").drop("pattern").unionByName(keys).distinct()
    spans = found.where(F.col("kind") < KINDS.index("other")).select(*ROW, "kind", "start", "stop").unionByName(added)
    listed = F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("all")
    by_row = spans.groupBy(*ROW).agg(listed)
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    rows = docs.select("doc_id", mark_of(docs).alias("mark"))
    same = rows["doc_id"].eqNullSafe(by_row["doc_id"]) & (rows["mark"] == by_row["mark"])
    joined = rows.join(by_row, same, "left").select(rows["doc_id"], rows["mark"], F.coalesce("all", F.array().cast("array<struct<kind: int, start: bigint, stop: bigint>>")).alias("all"))

    def count(number: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == number)).cast("long").alias(f"n_{KINDS[number]}")

    counts = [count(n) for n in range(len(KINDS))]
    base = F.filter("all", lambda s: s["kind"] < KINDS.index("other"))
    return joined.select(
        "doc_id", *counts[:-1], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"), counts[-1], F.size("all").cast("long").alias("n_spans"), "mark"
    )
