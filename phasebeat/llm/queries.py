"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phasebeat.llm import language, rule_ensemble, toxicity
from phasebeat.llm.centroids import centroid_clusters
from phasebeat.llm.common import table
from phasebeat.llm.decontamination import contamination
from phasebeat.llm.extraction import main_text
from phasebeat.llm.hard_negatives import hard_negatives
from phasebeat.llm.mixing import mixture
from phasebeat.llm.packing import shards
from phasebeat.llm.personal_data import personal_data
from phasebeat.llm.quality_rules import judged
from phasebeat.llm.simhash import near_duplicates
from phasebeat.llm.sql import ORACLES  # noqa: F401
from phasebeat.llm.suffixes import PASSAGE_WORDS, repeated_passages


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("mark")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("n_lines", "n_ellipsis_lines", "n_stop_words", "n_upper", "n_marks")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.id_remainder(3) != 1))
    found = language.languages(docs, model)
    return found.select("doc_id", (language.id_remainder(3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(language.id_remainder(5) != 0)
    found = rule_ensemble.quality(docs, rule_ensemble.fit(docs, labels))
    return found.select("doc_id", (language.id_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("mark")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_suffixes": op3_suffixes,
    "op4_quality_rules": op4_quality_rules,
    "op5_language": op5_language,
    "op6_decontamination": op6_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_sharding": op8_sharding,
    "op9_personal_data": op9_personal_data,
    "op10_toxicity": op10_toxicity,
    "op11_centroids": op11_centroids,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_extraction": op13_extraction,
}
