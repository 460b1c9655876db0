"""Language, quality and toxicity: held-out accuracy, parts against brute force, edge cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasebeat.llm import language, rule_ensemble, toxicity
from phasebeat.llm.language import best_path, identify
from phasebeat.llm.rule_ensemble import STATISTICS, fit_rules, statistics

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


# --- language


@pytest.mark.parametrize("seed", range(30))
def test_best_path_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n, k, penalty = int(rng.integers(1, 8)), int(rng.integers(1, 4)), 2.0
    scores = rng.normal(0, 3, (n, k)).round(3)

    def value(path):
        return scores[np.arange(n), list(path)].sum() - penalty * sum(a != b for a, b in zip(path, path[1:]))

    assert value(best_path(scores, penalty)) == pytest.approx(max(value(p) for p in itertools.product(range(k), repeat=n)))


def test_held_out_languages(docs):
    model = language.fit(docs.where(language.id_remainder(3) != 1))
    found = language.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.id_remainder(3) == 1)
    rows = found.collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) > 200
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_spans_and_scripts_narrow(spark):
    texts = {"en": "the quick brown fox and the dog with that house", "de": "der schnelle fuchs und das haus mit dem hund nicht", "ru": "быстрая лиса и дом где живёт собака"}
    rows = [(i, texts[k], k) for i, k in enumerate(list(texts) * 10)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert identify(" ".join([texts["en"]] * 3 + [texts["de"]] * 2), model)[::2] == ("en", 2)
    assert identify("неизвестные слова", model)[0] == "ru"
    assert identify("123 !? 42", model) == identify(None, model) == ("und", 0.0, 0)
    assert identify("中文", model)[2] == 1 and identify("中文", model)[1] <= 1


def test_language_edges(spark, edges, nothing):
    model = language.fit(edges)
    rows = language.languages(edges, model).collect()
    assert len(rows) == edges.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.fit(nothing) is None
    assert {r.lang_pred for r in language.languages(edges, None).collect()} == {"und"}
    assert language.languages(nothing, model).count() == 0


# --- quality


def test_held_out_quality(docs, labels):
    model = rule_ensemble.fit(docs, labels.where(language.id_remainder(5) != 0))
    assert 0 < len(model.rules) <= rule_ensemble.RULES
    found = rule_ensemble.quality(docs, model).join(labels, "doc_id").where(language.id_remainder(5) == 0).collect()
    assert sum(r.predicted == r.quality for r in found) > 0.95 * len(found) > 40
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_compiled_score_is_that_of_the_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7) | (x[:, 2] > 0.9)).astype(float)
    model = fit_rules(x, y)
    logit = np.full(len(x), model.intercept)
    for rule, weight in zip(model.rules, model.weights):
        held = np.ones(len(x), bool)
        for f, above, cut in rule:
            held &= (x[:, f] > cut) if above else (x[:, f] <= cut)
        logit += weight * held
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *STATISTICS])
    got = np.array([r.s for r in df.select("i", model.score().alias("s")).orderBy("i").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-logit)))
    assert ((got > 0.5) == y).mean() > 0.97


def test_statistics(spark):
    rows = [(1, "The the The\nA, b!\n\nA, b!"), (2, None)]
    one, two = statistics(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").orderBy("doc_id").collect()
    assert (one.n_words, one.distinct_words, one.same_as_last) == (7, 4 / 7, 0)
    assert (one.dup_lines, one.words_per_line, one.marks, one.upper) == (1 / 3, 7 / 3, 2 / 7, 4 / 7)
    assert all(two[s] == 0 for s in STATISTICS)


def test_quality_edges(spark, edges, nothing, labels):
    few = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for known in (few, few.where("false"), few.withColumn("quality", F.lit(1))):
        rows = rule_ensemble.quality(edges, rule_ensemble.fit(edges, known)).collect()
        assert len(rows) == edges.count() and all(r.score is not None for r in rows)
    assert rule_ensemble.quality(nothing, rule_ensemble.fit(nothing, labels)).count() == 0


# --- toxicity


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(language.id_remainder(5) != 0))
    held = labels.where(language.id_remainder(5) == 0).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.toxicity(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").collect()
    bad, good = [r for r in found if r.label == 1], [r for r in found if r.label == 0]
    assert sum(r.toxic for r in bad) > 0.88 * len(bad) > 50
    assert sum(r.toxic for r in good) < 0.01 * len(good)
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic for r in found)
    assert model.thresholds[0] < model.thresholds[1]


def test_regression_finds_ordered_grades():
    rng = np.random.default_rng(4)
    x = rng.random(900) * 3
    grade = np.digitize(x + rng.normal(0, 0.1, 900), [1.0, 2.0])
    weights, cuts = toxicity._regress(np.arange(900), np.zeros(900, int), x, grade, 1)
    assert weights[0] > 1
    assert np.allclose(cuts / weights[0], [1.0, 2.0], atol=0.25)


def test_toxic_rows_go_and_columns_stay(spark, edges, nothing):
    rng = random.Random(6)
    clean = [(i, " ".join(rng.choices(["house", "garden", "water", "stone"], k=30)), 0) for i in range(60)]
    bad = [(100 + i, clean[i][1] + " " + " ".join(rng.choices(["scoundrel", "villain"], k=3)), 1) for i in range(30)]
    known = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    model = toxicity.fit(known.drop("toxic"), known.drop("text"))
    kept = toxicity.without_toxic(edges.unionByName(known.drop("toxic"), allowMissingColumns=True), model)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in edges.collect()) + Counter(c[0] for c in clean)
    forms = spark.createDataFrame([(1, "the scoundrels are here"), (2, "stone garden")], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in toxicity.toxicity(forms, model).collect()} == {1: True, 2: False}
    assert toxicity.fit(edges, known.where("toxic = 0").drop("text")) is None
    assert not any(r.toxic for r in toxicity.toxicity(edges, None).collect())
    assert toxicity.without_toxic(nothing, model).count() == toxicity.toxicity(nothing, model).count() == 0


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(i, f"words of {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(docs, labels, 20).count() == 20
    sample = toxicity.labelled_sample(docs, labels, 100).collect()
    assert len(sample) == 59 and [r.text for r in sample if r.text.startswith("text")] == ["text 0"]
    before = rule_ensemble.fit(docs.dropDuplicates(["doc_id"]), labels)
    assert rule_ensemble.fit(docs, labels).weights == before.weights


@pytest.mark.parametrize("text", ["²", "½", "①", "12 ²³ ½"])
def test_numbers_of_other_kinds_are_no_letters(spark, text):
    rows = [(1, "the cat is here", "en"), (2, "le chat est ici", "fr")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = language.languages(spark.createDataFrame([(3, text)], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in found] == ["und"]


def test_quotes_are_no_part_of_a_word():
    plain = language._cleaned('"mot" - autre')
    typographic = language._cleaned("\u201cmot\u201d \u2013 autre")
    assert typographic.tobytes().split() == plain.tobytes().split() == [b"mot", b"autre"]
