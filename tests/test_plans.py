"""Whole ways through the engine with deterministic stand-ins for the providers."""

import datetime
import json

from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators.providers import embedded, hashed_words, judged_pairs
from sparkloom.plans import review as plans
from sparkloom.sources.pages import ListSource

HUNK = "@@ -1,2 +3,4 @@ def f\n+use MAX_SIZE to bound the buffer\n+return buffer"
DIFF = f"--- a/app/x.py\n+++ b/app/x.py\n{HUNK}\n--- a/app/y.py\n+++ b/app/y.py\n@@ -9 +9 @@ other\n+something that nobody ever wrote about before"


def comments(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, "o", "r", 1, "app/z.py", 5, HUNK.replace("buffer", w), f"{w} may overflow MAX_SIZE", "ann", f"http://c/{i}", at + datetime.timedelta(days=i)) for i, w in enumerate(("buffer", "buffer", "queue", "list"))]
    df = spark.createDataFrame(rows, "github_comment_id long, repo_owner string, repo_name string, pr_number int, path string, line int, diff_hunk string, body string, author string, html_url string, comment_created_at timestamp")
    return embedded(df, "diff_hunk", hashed_words())


def test_review(spark):
    changes = spark.createDataFrame([(1, "o", "r", "sha1", DIFF), (2, "o", "r", "sha2", ""), (3, "o", "r", "sha3", None)], "review_id long, repo_owner string, repo_name string, head_sha string, diff string")

    def synthesize(rows):
        item = {"evidence": "seen before", "suggested_check": "test it", "source_indices": [0, 1]}
        return [json.dumps({"concerns": [item | {"concern": "the buffer may overflow", "confidence": 0.6}, item | {"concern": "The buffer may overflow", "confidence": 0.8}, item | {"concern": "unsupported", "source_indices": [50]}]}) for _ in rows]

    got = {r.review_id: r for r in plans.review(changes, comments(spark), hashed_words(), synthesize).collect()}
    assert [f.concern for f in got[1].findings] == ["the buffer may overflow"] and got[1].findings[0].confidence == 0.8
    assert got[1].outcome == "completed_with_findings" and got[1].body.startswith("<!-- review:sha1 -->") and "### Finding 1: the buffer may overflow" in got[1].body
    assert got[2].outcome == got[3].outcome == "general_analysis_only" and got[2].hunks_scanned == 0
    failed = plans.review(changes.where("review_id = 1"), comments(spark), hashed_words(), lambda rows: [None for _ in rows]).first()
    assert failed.outcome == "external_failure" and failed.findings is None


def test_ingest(spark):
    api = spark.createDataFrame([(0, "u/1", "a.py", 1, 1, "@@ x", "known", ("a",), "2024-05-01T10:00:00Z", "h"), (9, "u/2", "a.py", 1, 1, "@@ y", "new", ("a",), "2024-05-01T10:00:00Z", "h"), (8, "u/2", "a.py", 1, 1, "", "blank", ("a",), "2024-05-01T10:00:00Z", "h")], schemas.API_COMMENT)
    rows = plans.ingest(api, comments(spark), hashed_words(), "o", "r").collect()
    assert [(r.github_comment_id, r.pr_number, len(r.embedding)) for r in rows] == [(9, 2, 64)]


def test_evaluate(spark):
    at = datetime.datetime(2024, 1, 1)
    words = ("buffer", "queue", "list")
    rows = [(i, "o", f"r{i % 2}", HUNK.replace("buffer", words[i % 3]), f"{words[i % 3]} number may overflow", "bot[bot]" if i == 90 else "ann", at + datetime.timedelta(hours=i)) for i in range(100)]
    df = embedded(spark.createDataFrame(rows, "github_comment_id long, repo_owner string, repo_name string, diff_hunk string, body string, author string, comment_created_at timestamp").withColumn("path", F.lit("a.py")), "diff_hunk", hashed_words())
    split = at + datetime.timedelta(hours=60)
    asked = spark.sparkContext.accumulator(0)

    def judge(a, b):
        asked.add(1)
        return a == b, "equal"

    out = plans.evaluate(df, split, hashed_words(), lambda hits: hits.select("query_id", F.col("body").alias("concern")).distinct(), judge, tune=6, test_max=8, test_min=4)
    samples = out["samples"].collect()
    assert len(samples) == 14 and all(s.query_id >= 60 and s.query_id != 90 for s in samples)
    final = out["final"].first()
    # Only test samples that reach the floor went to the judge.
    assert 0 < sum(s.judge_reason is not None for s in samples) <= asked.value <= 8
    assert all(s.judge_reason is None for s in samples if s.part == "tune" or (s.best_similarity or 0) < final.floor)
    assert final.tp + final.fn == 8 and out["cold_start"].first().n_samples == 8


def test_providers_fail_as_data(spark):
    def broken(*_):
        raise RuntimeError("down")

    rows = spark.createDataFrame([(1, "a", "b")], "id int, concern string, body string")
    assert embedded(rows, "concern", broken).first().embedding is None
    r = judged_pairs(rows, broken).first()
    assert r.same_concern is False and r.judge_reason.startswith("judge_error")


def test_list_source(spark):
    def client(url, params):
        return [{"u": url, "i": i} for i in range(3)], None

    class Here(ListSource):
        pass

    Here.client = staticmethod(client)
    spark.dataSource.register(Here)
    rows = spark.read.format("rest_list").option("urls", "a b").option("per_page", "3").option("max_items", "2").load().collect()
    assert sorted((r.url, json.loads(r.item)["i"]) for r in rows) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_schemas(spark):
    for name in dir(schemas):
        if name.isupper() and name != "VECTOR":
            assert spark.createDataFrame([], getattr(schemas, name)).count() == 0
