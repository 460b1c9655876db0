"""From raw documents to shards of training text, in five stages.

Each stage is written as a table and read again as the documents of the next one, so that a lost executor costs the tasks of
one stage.  All stages but the last return the columns of ``documents``; the last one tells where every document goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasebeat.llm import toxicity
from phasebeat.llm.common import joined, table
from phasebeat.llm.decontamination import contamination
from phasebeat.llm.mixing import mixture
from phasebeat.llm.packing import shards
from phasebeat.llm.simhash import near_duplicates
from phasebeat.workspace import store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a toxic grade is below a half.

    Null and empty texts have no marked words and stay.  Repeated rows are judged alike.  An empty table gives no rows.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest id (null ids last), then the smallest fingerprint of the text.

    Four-word shingles and at most 4 differing bits, as ``op2_simhash`` links them.  Of repeated rows one stays.  Null and empty
    texts have the fingerprint zero and are one group.  An empty table gives no rows.
    """
    found = near_duplicates(docs).where("kept").groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    rows = joined(docs, found, "inner")
    # Only repeated rows are numbered; each task passes on one row of a key at most.
    number = F.row_number().over(Window.partitionBy("_id", "_mark").orderBy(F.lit(1)))
    repeated = rows.where("n > 1").withColumn("_number", number).where("_number = 1")
    return rows.where("n = 1").select("_row.*").unionByName(repeated.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have no words and stay; repeated rows go or stay together.  An empty table gives no rows.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return joined(docs, found.where("contaminated").select("doc_id", "mark").distinct(), "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them, which is once or more.

    Rows of a null source are a source of their own; texts without words are drawn like others.  Repeated rows are documents of
    their own.  An empty table gives no rows.
    """
    draws = mixture(docs).groupBy("doc_id", "mark").agg(F.countDistinct("epoch").alias("times"))
    rows = joined(docs, draws, "inner")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, with the columns of ``documents`` besides the text.

    Null texts have no bytes and are placed like others; repeated rows are placed one by one.  An empty table gives no rows.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    return shards(docs, keep=rest).drop("law", "grown_shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

# Fitted models and fingerprints are beyond SQL; the tests compare each stage with a plain one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
