"""Queries that write: batches merged by key, some of them twice, and what the tables then hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators import corpus, report
from sparkloom.plans import tables as t
from sparkloom.plans.catalogue import JUDGED
from sparkloom.plans.registry import query
from sparkloom.sinks import keyed, reports
from sparkloom.streaming import running
from sparkloom.streaming.verdicts import GroundTruth


@query("snk1_insert_again", "SELECT doc_id, source, lang, sha256(text) AS text_sha256, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END::INTEGER AS batch FROM documents")
def snk1(spark, d):
    """A third of the corpus, then all of it, then all again: each row is there once, as it first came."""
    path = running.shared_folder(spark, "corpus")
    docs = t.table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_sha256"))
    for n, rows in enumerate((docs.where("doc_id % 3 = 0"), docs, docs)):
        corpus.insert_if_absent(rows.withColumn("batch", F.lit(n + 1)), path, "doc_id")
    return keyed.stored(spark, path).drop(keyed.BUCKET)


@query("snk7_fill_again", "SELECT d.doc_id, coalesce(CASE WHEN d.lang = 'en' THEN 1 END, l.quality)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def snk7(spark, d):
    """Null labels of the corpus filled from the labels table, twice."""
    path = running.shared_folder(spark, "labels")
    keyed.upsert(t.table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", 1).alias("quality")), path, ["doc_id"])
    for _ in range(2):
        keyed.upsert(t.table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), path, ["doc_id"], "fill")
    return keyed.stored(spark, path).drop(keyed.BUCKET)


@query(
    "snk5_marked_reports",
    "WITH n AS (SELECT user_id::VARCHAR AS mark, event_id, event_type, event_type = 'click' AS new, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts DESC, event_id DESC) AS nth FROM events), l AS (SELECT * FROM n WHERE nth = 1) SELECT mark, min_by(event_id, new) AS comment_id, '<!-- review:' || mark || ' -->' || chr(10) || chr(10) || max_by(event_type, new) AS body FROM l GROUP BY mark",
)
def snk5(spark, d):
    """Reports found again by their mark: a later one replaces the body under the comment's first id."""
    path = running.shared_folder(spark, "reports")
    e = t.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("comment_id"), report.marked(F.col("event_type"), F.col("user_id").cast("string")).alias("body"), "ts", "event_type")
    rows = rows.withColumn("mark", reports.mark_of(F.col("body")))
    newest = [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("comment_id")]
    for batch in (rows.where("event_type <> 'click'"), rows.where("event_type = 'click'"), rows.where("event_type = 'click'")):
        last = keyed.one_a_key(batch.select("mark", "comment_id", "body", "ts"), ["mark"], newest)
        keyed.upsert(last.drop("ts"), path, ["mark"], "replace", keep=("comment_id",))
    return keyed.stored(spark, path).drop(keyed.BUCKET)


def _judge(pairs: DataFrame) -> DataFrame:
    same = (F.col("prediction_id") + F.col("comment_id")) % 2 == 0
    return pairs.withColumn("similarity", ((F.col("prediction_id") * 31 + F.col("comment_id") * 17) % 100) / F.lit(100.0)).withColumn("same_concern", same).withColumn("judge_reason", F.when(same, "same").otherwise("different"))


def _ran(spark: SparkSession, d: str) -> GroundTruth:
    """Clicks and purchases as predictions; errors and views come as a stream of comments."""
    sink = GroundTruth(running.shared_folder(spark, "predictions"), running.shared_folder(spark, "misses"), _judge, ("path",))
    known = t.predictions_at_lines(spark, d)
    sink.open(known, known)
    running.drained(t.comments_of(t.with_k(t.streamed(spark, d, "events"))), "verdicts", sink)
    return sink


@query("st13_verdict_stream", f"{JUDGED} SELECT p.prediction_id, coalesce(p.matched, f.m) AS matched, CASE WHEN f.won THEN 'embedding+judge' END AS match_type, CASE WHEN f.won THEN f.comment_id END AS source_comment_id, CASE WHEN f.m IS NOT NULL THEN f.reason END AS match_reason FROM pr p LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (prediction_id)")
def st13(spark, d):
    return keyed.stored(spark, _ran(spark, d).predictions).select("prediction_id", "matched", "match_type", "source_comment_id", "match_reason")


@query("snk3_missed_comments", f"WITH {t.PLACED} SELECT comment_id, path, line FROM cm WHERE path <> '' AND line IS NOT NULL AND comment_id NOT IN (SELECT comment_id FROM pairs)")
def snk3(spark, d):
    sink = _ran(spark, d)
    none = t.comments_at_lines(spark, d)
    return keyed.stored(spark, sink.misses, none).select("comment_id", "path", "line")
