"""Resource use of the watched processes, from chunks of a traffic log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.functions import text
from phasebeat.operators.ordered import scan
from phasebeat.workspace import store

# The line that ends a chunk, the mark of helper connections, fields of a line.
REFRESH = "Refreshing:"
HELPER = "ssh/"
FIELDS = 3


def chunked(lines: DataFrame, keys: list[str], segment_rows: int | None = None, mark: str = REFRESH) -> DataFrame:
    """Number the chunk of each line; a mark line belongs to the chunk that it ends.

    A chunk still open at the end of the log is left out.
    """
    is_mark = F.col("line") == mark
    rows = scan(lines, keys, "line_no", sums={"marks": is_mark.cast("long")}, segment_rows=segment_rows)
    rows = rows.withColumn("chunk", F.col("marks") - is_mark.cast("long"))
    # A total over the whole log, so it is made by aggregation and not by a window over one key.
    ends = lines.where(is_mark).groupBy(*keys).agg(F.count("*").alias("closed_chunks"))
    return rows.join(ends, keys).where(F.col("chunk") < F.col("closed_chunks")).drop("marks", "closed_chunks")


def process_tree(processes: DataFrame, main: Column, key: str = "host") -> DataFrame:
    """The main process of each host and all its descendants.

    Each round doubles the number of generations looked back, so a tree of depth ``d`` takes ``log2(d)`` rounds.
    Processes whose ancestors form a circle, as reused pids can make them, have no main process.
    A round reads and writes the rows that are still open; rows that are settled stay in the table of their round.
    Tables of processes take few bytes for many rows, so the joins are merges and never broadcasts.
    """
    up = F.when(F.col("ppid") != F.col("pid"), F.col("ppid"))
    watched = F.coalesce(main, F.lit(False))
    rows = store(processes.select(key, "pid", F.when(~watched, up).alias("up"), watched.alias("is_main"), watched.alias("watched")), "processes")
    settled, open_ = [rows.where(F.col("up").isNull())], rows.where(F.col("up").isNotNull())
    now, before = open_.count(), None
    # Each round settles the ends of every open chain; what is left when none settles runs in circles.
    while now and now != before:
        before = now
        state = reduce(DataFrame.unionByName, [*settled, open_])
        parent = state.select(key, F.col("pid").alias("up"), F.col("up").alias("next"), F.col("watched").alias("by"))
        reached = F.coalesce("by", F.lit(False))
        looked = open_.join(parent.hint("merge"), [key, "up"], "left").select(
            key, "pid", F.when(~reached, F.col("next")).alias("up"), "is_main", reached.alias("watched")
        )
        rows = store(looked, "processes")
        settled, open_ = [*settled, rows.where(F.col("up").isNull())], rows.where(F.col("up").isNotNull())
        now = open_.count()
    state = reduce(DataFrame.unionByName, settled)
    found = state.where("watched").select(key, "pid", "is_main")
    return processes.join(found.hint("merge"), [key, "pid"])


def usage_by_chunk(
    lines: DataFrame, watched: DataFrame, chunk_keys: list[str], host: str = "host", exact: bool = False
) -> DataFrame:
    """Upload, download, cpu and mem per chunk.

    A line counts for the first watched process, the main one first, whose pid occurs anywhere in
    its first token; with ``exact`` only in its pid field.  Helper connections count for traffic
    only.  Hosts without a main process report zeros.

    Which process a token belongs to is found once per host and token.  A pid occurs in a token if it is a piece of one of the
    token's runs of digits; these pieces, as long as the longest pid at most, are joined with the pids, so a host with
    many processes costs no more per line than one with few.
    """
    parts = F.split(text.strip(F.col("line")), r"\s+")
    hosts = watched.select(host).distinct().withColumn("has_main", F.lit(True))
    rows = lines.withColumn("parts", parts).withColumn("token", F.get("parts", F.lit(0))).join(hosts, host, "left")
    helper = F.col("token").contains(HELPER)
    usable = (F.size("parts") >= FIELDS) & F.coalesce("has_main", F.lit(False))
    rows = rows.withColumns({"usable": usable, "helper": helper})

    pid = watched["pid"].cast("string")
    listed = watched.select(host, pid.alias("piece"), F.struct((~F.col("is_main")).alias("after"), "pid", "cpu", "mem").alias("process"))
    tokens = rows.where("usable AND NOT helper").select(host, "token").distinct()
    if exact:
        pieces = tokens.withColumn("piece", F.try_element_at(F.split("token", "/"), F.lit(-2)))
    else:
        longest = watched.agg(F.max(F.length(pid))).first()[0] or 0
        pieces = tokens.select(host, "token", F.explode(digit_pieces(F.col("token"), longest)).alias("piece"))
    # One row per token: the least process in the order of the list.
    owners = pieces.join(listed.hint("merge"), [host, "piece"]).groupBy(host, "token").agg(F.min("process").alias("proc"))
    owned = rows.join(owners.hint("merge"), [host, "token"], "left")
    proc = F.when(F.col("usable") & ~F.col("helper"), F.col("proc"))
    counts = F.col("usable") & (F.col("helper") | proc.isNotNull())

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(counts, value)), F.lit(0.0))

    return owned.groupBy(*chunk_keys).agg(
        total(F.get("parts", F.lit(1)).try_cast("double")).alias("upload"),
        total(F.get("parts", F.lit(2)).try_cast("double")).alias("download"),
        total(proc["cpu"]).alias("cpu"),
        total(proc["mem"]).alias("mem"),
    )


def digit_pieces(token: Column, longest: int) -> Column:
    """All different pieces of the runs of digits in a token, up to ``longest`` digits each."""
    runs = F.array_distinct(F.regexp_extract_all(token, F.lit(r"([0-9]+)")))

    def of(run: Column) -> Column:
        def at(start: Column) -> Column:
            most = F.least(F.lit(longest), F.length(run) - start + 1)
            return F.transform(F.sequence(F.lit(1), most), lambda n: F.substr(run, start, n))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), at))

    return F.array_distinct(F.flatten(F.transform(runs, of))) if longest else F.array().cast("array<string>")
