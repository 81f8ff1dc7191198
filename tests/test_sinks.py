"""Keyed tables and the ground-truth stream: what runs again changes nothing."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkloom.operators import groundtruth
from sparkloom.sinks import keyed, reports
from sparkloom.streaming import running
from sparkloom.streaming.verdicts import GroundTruth

ROW = "id long, v string, w int"


def rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "v", "w").collect()))


def files(path):
    return {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_absent_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(1, "a", 1), (2, "b", None), (2, "b", None), (None, "no key", 0), (3, None, 5)], ROW)
    assert keyed.upsert(batch, path, ["id"], buckets=4) == {"inserted": 3, "updated": 0, "skipped": 2}
    before, had = rows(spark, path), files(path)
    assert before == [(1, "a", 1), (2, "b", None), (3, None, 5)]
    assert keyed.upsert(batch, path, ["id"], buckets=4) == {"inserted": 0, "updated": 0, "skipped": 5}
    assert rows(spark, path) == before and files(path) == had
    more = spark.createDataFrame([(1, "other", 9), (4, "d", 4)], ROW)
    assert keyed.upsert(more, path, ["id"], buckets=4) == {"inserted": 1, "updated": 0, "skipped": 1}
    assert rows(spark, path) == sorted([*before, (4, "d", 4)])
    kept = {f for f in had if f in files(path)}
    assert kept, "buckets without a change keep their files"


def test_replace_and_fill(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(spark.range(100).select("id", F.lit("old").alias("v"), F.when(F.col("id") % 2 == 0, 1).alias("w")), path, ["id"], buckets=8)
    new = spark.createDataFrame([(5, "new", 7), (6, "new", None), (200, "new", 3)], ROW)
    assert keyed.upsert(new, path, ["id"], "replace", 8, keep=("w",)) == {"inserted": 1, "updated": 2, "skipped": 0}
    assert keyed.upsert(new, path, ["id"], "replace", 8, keep=("w",)) == {"inserted": 0, "updated": 0, "skipped": 3}
    got = {r[0]: r[1:] for r in rows(spark, path)}
    assert got[5] == ("new", None) and got[6] == ("new", 1) and got[200] == ("new", 3) and len(got) == 101 and got[7] == ("old", None)
    fill = spark.createDataFrame([(7, "x", 70), (8, "x", 80), (999, "x", 1)], ROW)
    assert keyed.upsert(fill, path, ["id"], "fill", 8) == {"inserted": 0, "updated": 1, "skipped": 2}
    got = {r[0]: r[1:] for r in rows(spark, path)}
    assert got[7] == ("old", 70) and got[8] == ("old", 1) and 999 not in got


def test_ties_and_order_pick_one_row(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3)], ROW)
    for parts in (1, 3):
        assert [tuple(r) for r in keyed.one_a_key(batch.repartition(parts), ["id"]).collect()] == [(1, "a", 1)]
        assert [tuple(r) for r in keyed.one_a_key(batch.repartition(parts), ["id"], [-F.col("w")]).collect()] == [(1, "c", 3)]
    with pytest.raises(ValueError):
        keyed.upsert(batch, path, ["id"], "other")
    assert keyed.upsert(batch.limit(0), path, ["id"]) == {"inserted": 0, "updated": 0, "skipped": 0} and not os.path.exists(path)


# ---- ground truth ----

PREDICTIONS = "prediction_id long, path string, predicted_line int, matched boolean"
COMMENTS = "comment_id long, path string, line int"


def judge(pairs):
    same = (F.col("prediction_id") + F.col("comment_id")) % 2 == 0
    return pairs.withColumn("similarity", ((F.col("prediction_id") * 31 + F.col("comment_id") * 17) % 100) / F.lit(100.0)).withColumn("same_concern", same).withColumn("judge_reason", F.when(same, "same").otherwise("different"))


def tables(spark, sink):
    p = {r.prediction_id: (r.matched, r.match_type, r.source_comment_id, r.match_reason, r.batch) for r in spark.read.parquet(sink.predictions).collect()}
    m = sorted(r.comment_id for r in spark.read.parquet(sink.misses).collect()) if os.path.exists(sink.misses) else []
    return p, m


def some(spark, n=60):
    predictions = spark.range(n).select(F.col("id").alias("prediction_id"), F.concat(F.lit("p"), F.col("id") % 5).alias("path"), F.when(F.col("id") % 7 > 0, F.col("id").cast("int")).alias("predicted_line"), F.when(F.col("id") % 11 == 0, True).alias("matched"))
    comments = spark.range(100, 100 + n).select(F.col("id").alias("comment_id"), F.concat(F.lit("p"), F.col("id") % 6).alias("path"), (F.col("id") % 80).cast("int").alias("line"))
    return predictions, comments


def test_batch_again_changes_nothing_wherever_it_broke(spark, tmp_path, monkeypatch):
    predictions, comments = some(spark)
    sink = GroundTruth(str(tmp_path / "p"), str(tmp_path / "m"), judge, ("path",), 4)
    sink.open(predictions, predictions)
    want = {r.prediction_id: tuple(r)[1:] for r in groundtruth.judged(judge(groundtruth.candidate_pairs(comments, predictions, ["path"]))).where("matched is not null").collect()}
    misses = sorted(r.comment_id for r in groundtruth.false_negatives(comments, predictions, ["path"]).collect())
    real, calls = keyed.upsert, []

    def broken(*a, **b):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost between the writes")
        return real(*a, **b)

    monkeypatch.setattr(keyed, "upsert", broken)
    with pytest.raises(RuntimeError):
        sink(comments, 0)
    monkeypatch.setattr(keyed, "upsert", real)
    sink(comments, 0)
    first = tables(spark, sink)
    judged = {k: v[:4] for k, v in first[0].items() if v[4] == 0}
    assert judged == want and first[1] == misses
    assert all(v[0] is True and v[4] is None for k, v in first[0].items() if k % 11 == 0)
    sink(comments, 0)
    assert tables(spark, sink) == first
    sink(comments.where("comment_id % 2 = 0"), 1)
    second = tables(spark, sink)
    assert all(second[0][k] == v for k, v in first[0].items() if v[0] is not None), "verdicts stay"
    sink(comments.where("comment_id % 2 = 0"), 1)
    assert tables(spark, sink) == second


def test_stream_of_comments(spark, tmp_path):
    predictions, comments = some(spark)
    sink = GroundTruth(str(tmp_path / "p"), str(tmp_path / "m"), judge, ("path",), 4)
    sink.open(predictions, predictions)
    comments.coalesce(1).write.parquet(str(tmp_path / "in"))
    running.drained(spark.readStream.schema(COMMENTS).parquet(str(tmp_path / "in")), "verdicts", sink)
    want = {r.prediction_id: tuple(r)[1:] for r in groundtruth.judged(judge(groundtruth.candidate_pairs(comments, predictions, ["path"]))).where("matched is not null").collect()}
    assert {k: v[:4] for k, v in tables(spark, sink)[0].items() if v[4] == 0} == want
    claims = [v[2] for v in tables(spark, sink)[0].values() if v[2] is not None]
    assert len(claims) == len(set(claims)), "a comment confirms one prediction"


# ---- reports ----


class Service:
    """Comments in memory; the first answers of a place may be refusals."""

    def __init__(self, *answers):
        self.answers, self.comments, self.waits = list(answers), {}, []

    def answer(self):
        if self.answers:
            problem = self.answers.pop(0)
            if problem is not None:
                raise problem

    def find(self, place, mark):
        return next((i for i, (p, b) in self.comments.items() if p == place and f"review:{mark} " in b), None)

    def update(self, place, known, body):
        self.answer()
        self.comments[known] = (place, body)

    def create(self, place, body):
        i = len(self.comments) + 1
        self.comments[i] = (place, body)
        self.answer()  # it may be posted though the answer is lost
        return i


def test_delivery_finds_its_mark_and_retries():
    body = "<!-- review:abc -->\n\nfirst"
    one = lambda service, retries=3: reports.deliver_one(service, "o/r/1", "abc", body, retries, 30.0, service.waits.append)
    s = Service(TimeoutError("lost"))
    assert one(s) == ("1", "updated", 2, None) and len(s.comments) == 1 and s.waits == [1.0]
    assert one(s) == ("1", "updated", 1, None)
    s = Service(reports.Refused(429, 7.0), reports.Refused(503))
    assert one(s)[1:3] == ("updated", 3) and s.waits == [7.0, 2.0]
    assert one(Service(reports.Refused(404)))[1:3] == ("failed", 1)
    assert one(Service(reports.Refused(403, spent=True)))[1:3] == ("updated", 2) and one(Service(reports.Refused(403)))[1:3] == ("failed", 1)
    assert one(Service(reports.Refused(429, 900.0)))[1:3] == ("failed", 1)
    assert one(Service(*[ConnectionError()] * 9), 2)[1:] == ("failed", 3, "ConnectionError: ")


def test_delivery_of_a_table(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks do not see this folder
    rows = spark.createDataFrame([(1, "p", "<!-- review:a -->\n\nold"), (2, "p", "<!-- review:a -->\n\nnew"), (3, "q", "no mark"), (4, "q", "no mark"), (5, "p", None)], "review_id long, place string, body string")
    got = {r.review_id: (r.action, r.attempts) for r in reports.delivered(rows.where("body is not null"), Service()).collect()}
    assert got == {2: ("created", 1), 3: ("created", 1), 4: ("created", 1)}
    assert reports.delivered(rows.limit(0), Service()).count() == 0
    assert [r.m for r in rows.select(reports.mark_of(F.col("body")).alias("m")).collect()] == ["a", "a", None, None, None]


def test_run_record_is_written_once(spark, tmp_path):
    import datetime
    import json

    from sparkloom.operators import metrics
    from sparkloom.sinks import artifacts

    schema = "sample_id long, had_retrieval boolean, num_concerns int, best_similarity double, best_concern string, real_comment string, judge_confirmed boolean, judge_reason string"
    # 0.4496 rounds to 0.45: over that threshold when the floor is tuned, but the judge is not asked.
    rows = [(1, True, 2, 0.4496, "a", "x", True, "j"), (2, True, 1, 0.8, "b", "y", True, "j"), (3, False, 4, 0.9, "c", "z", True, "j"), (4, True, 0, 0.9, "d", "w", True, "j"), (5, True, 3, None, None, None, None, None), (6, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    pool = spark.createDataFrame([("o", "r")] * 3 + [("o", "q")], "repo_owner string, repo_name string")
    at, split = datetime.datetime(2024, 6, 1, 2, 3, 4), datetime.datetime(2024, 1, 1)
    tune = metrics.sample_results(df)
    record = artifacts.run_record(pool, tune, metrics.sample_results(df, 0.45), at, split)
    path = artifacts.write_record(record, str(tmp_path), at)
    assert path.endswith("held_out_eval_20240601_020304")
    got = json.loads(spark.read.text(path).first().value)
    assert got["repo_pool"] == ["o/q", "o/r"] and got["pool_sizes_by_repo"] == {"o/q": 1, "o/r": 3}
    assert (got["run_at"], got["split_date"], got["tune_size"], got["test_size"]) == ("2024-06-01T02:03:04", "2024-01-01T00:00:00", 6, 6)
    assert got["floor_selected"] == 0.45 and got["tuning_sweep"][0] == {"threshold": 0.45, "tp": 2, "fp": 4, "fn": 4, "precision": 0.333, "recall": 0.333, "f1": 0.333}
    assert got["final_metrics"] == {"floor": 0.45, "tp": 1, "fp": 5, "fn": 5, "precision": 0.167, "recall": 0.167, "f1": 0.167}
    assert (got["no_retrieval_match_count"], got["no_retrieval_match_pct"]) == (2, 33.3)
    samples = {s.pop("sample_id"): s for s in got["test_sample_results"]}
    assert list(samples) == [1, 2, 3, 4, 5, 6]
    assert (samples[1]["best_similarity"], samples[1]["judge_confirmed"]) == (0.45, None)
    assert samples[3] == {"had_retrieval": False, "num_concerns": 0, "best_similarity": None, "best_concern": None, "real_comment": "z", "judge_confirmed": None, "judge_reason": None}
    assert samples[5]["best_similarity"] == 0.0
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_record(record, str(tmp_path), at)
    none = json.loads(artifacts.run_record(pool.limit(0), tune.limit(0), tune.limit(0), at, split).first().artifact)
    assert none["repo_pool"] == [] and none["test_sample_results"] == [] and none["no_retrieval_match_pct"] is None
