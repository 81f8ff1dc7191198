"""Fitting samples stay bounded and fair when ids repeat or are missing; keys and sizes are what they say."""

import warnings

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language, mixing, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, ids, n=600):
    words = {"en": "the house and this water with that", "de": "das haus und dieses wasser mit jenem"}
    return spark.createDataFrame([(ids(i), f"{words[g]} {g}{i % 50 if i < n // 2 else i}", g, "s", None) for i in range(n) for g in words], SCHEMA)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 3])
def test_language_sample_with_repeated_ids(spark, ids):
    docs = table(spark, ids)
    model = language.fit_languages(docs, fit_rows=100)
    assert model.languages == ["de", "en"]
    got = language.predict_languages(docs, model, ["lang"])
    assert got.where("lang = lang_pred").count() == got.count() == 1200


def test_one_row_many_times(spark):
    docs = table(spark, lambda i: i, 4).unionByName(spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("encore une fois la même").alias("text"), F.lit("fr").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars")))
    model = language.fit_languages(docs, fit_rows=30)
    assert model.languages == ["de", "en", "fr"]


def test_topic_start_is_bounded(spark, monkeypatch):
    seen = []
    real = mixing.spherical_kmeans
    monkeypatch.setattr(mixing, "spherical_kmeans", lambda x, k: seen.append(len(x)) or real(x, k))
    rows = spark.range(3000).select((F.col("id") % 5).alias("k"), F.concat_ws(" ", F.lit("a b"), F.col("id") % 5).alias("text"))
    assert len(mixing.fit_topics(mixing.with_bags(rows, ["k"]), "k", start_rows=64)) == 5
    assert seen == [5]


def test_features_of_long_texts_count_each_pair_once():
    text = "abc def " * 100
    assert abs(language.features(text) - language.features(text, at_once=64)).max() < 1e-12


def test_impossible_targets_are_told(spark):
    placed = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 10)], "k long, s string, t string, n_tokens long")
    targets = {"s": {"a": 0.9, "b": 0.1}, "t": {"x": 0.1, "y": 0.9}}
    with pytest.raises(ValueError, match="miss their targets"):
        mixing.mix(placed, targets, "k", strict=True)
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.mix(placed, targets, "k")
    _, error = mixing.rake_frame(placed.select("s", "t", F.col("n_tokens").alias("mass")), targets, rounds=2)
    assert error > 0.1
    assert mixing.stalled([1.0] * 30) and not mixing.stalled([0.9**i for i in range(30)])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixing.mix(placed, {"s": 0.5, "t": 0.5}, "k")


def test_keys_and_sizes(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "b")], "doc_id long, text string")
    assert shared.keyed_rows(rows, "doc_id", "text").select("row_key").distinct().count() == 3
    sized = spark.createDataFrame([(1, "x" * 1000, [(1, 2)] * 50, ["y" * 10] * 5), (2, None, None, None)], "a long, b string, c array<struct<p: long, q: long>>, d array<string>")
    assert 1000 + 50 * 32 + 5 * 26 <= shared.memory_bytes(sized) <= 1.2 * (1000 + 50 * 32 + 5 * 26) + 300
    assert shared.memory_bytes(sized.limit(0)) == 0
