"""Secrets planted in the driver's documents, kinds of findings the forest never saw, and plain words beside keys."""

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sparkloom.llm import secret_scan

PLANTED = re.compile(r'\btoken = "([0-9a-f]{40})"')


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def forest(docs):
    return secret_scan.corpus_forest(docs)


def test_recall_and_precision_on_documents(docs, forest):
    want = {(r.doc_id, m.start(1), m.group(1)) for r in docs.select("doc_id", "text").collect() for m in PLANTED.finditer(r.text or "")}
    got = {(r.doc_id, r.start, r.secret) for r in secret_scan.scan_secrets(docs, forest, ["doc_id"]).collect()}
    assert len(want) > 5 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_kinds_the_forest_never_saw(spark):
    """Every fifth kind is held out in turn: those findings have to be told apart from what the other kinds teach."""
    findings = secret_scan.labelled_findings(spark, 60).cache()
    right = total = 0
    for fold in range(5):
        forest = secret_scan.fit_forest(findings.where(F.col("kind") % 5 != fold))
        row = forest.judged(findings.where(F.col("kind") % 5 == fold)).agg(F.count("*"), F.sum(((F.col("probability") >= 0.5) == (F.col("label") == 1)).cast("int"))).first()
        total, right = total + row[0], right + row[1]
    assert right >= 0.75 * total


def test_new_kinds_of_candidates(spark, forest):
    letters = "qWxTzRbNmKpLsDfGhJvCyQwXtZrBnMkPlSdF"
    texts = [
        (f"push with ghp_{letters} now", [f"ghp_{letters}"]),
        ("postgres://svc:Zk8rT2qLw9Xb4@db.host/x and http://host:8080/path", ["Zk8rT2qLw9Xb4"]),
        ("the password is Xk29vQz7LmT4w and stays", ["Xk29vQz7LmT4w"]),
        ("the password is required and the token is invalid", []),
        ("see src/main/service/controller/handler/request/message and so on", []),
        (" ".join(["token=" + "7f3a" * 10] * 400), ["7f3a" * 10] * 400),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, (t, _) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = secret_scan.scan_secrets(df, forest, ["doc_id"]).orderBy("doc_id", "start").collect()
    for i, (text, want) in enumerate(texts):
        mine = [r for r in got if r.doc_id == i]
        assert [r.secret for r in mine] == want, text
        assert all(text[r.start : r.start + r.n_chars] == r.secret for r in mine)


def test_corpus_words(spark):
    df = spark.createDataFrame([("The the cat, 'cat' sat.",), (None,), ("",), ("sat x1 the",)], "text string")
    assert secret_scan.corpus_words(df) == ["the", "cat", "sat"]
    assert secret_scan.corpus_words(df, most=1) == ["the"] and secret_scan.corpus_words(df.limit(0)) == []
