"""The library's operators as queries over whole tables, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window, functions as F

from sparkloom.functions import paths, retry, text
from sparkloom.functions.vectors import cosine_similarity
from sparkloom.operators import corpus, diff, evalsplit, findings, groundtruth, metrics, report, retrieval, reviews
from sparkloom.operators.similar_sets import similar_sets
from sparkloom.plans import tables as t
from sparkloom.plans.review import settled
from sparkloom.plans.registry import query
from sparkloom.sinks import artifacts
from sparkloom.sources import pages, webhooks

# ---- retrieval ----


@query("j1_vector_topk", f"WITH {t.PAIRS} SELECT query_id, id, nth, round(sim, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS nth FROM vp WHERE query_id <> id) WHERE nth <= 20")
def j1(spark, d):
    return retrieval.top_similar(t.vector_queries(spark, d), t.vectors(spark, d), 20, exclude_self=True).withColumn("similarity", F.round("similarity", 9))


@query("f1_similarity_threshold", f"WITH {t.PAIRS} SELECT query_id, id, round(sim, 9) AS similarity FROM vp WHERE sim >= 0.25 AND query_id <> id")
def f1(spark, d):
    return retrieval.top_similar(t.vector_queries(spark, d), t.vectors(spark, d), 1 << 30, 0.25, exclude_self=True).select("query_id", "id", F.round("similarity", 9).alias("similarity"))


@query("v1_cosine_to_label_mean", "WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i) SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 9) AS similarity FROM e JOIN m USING (label, i) GROUP BY vec_id")
def v1(spark, d):
    e = t.vectors(spark, d)
    parts = e.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return e.join(means, "label").select(F.col("id").alias("vec_id"), F.round(cosine_similarity(F.col("vector"), F.col("mean")), 9).alias("similarity"))


_RANKED = rf"""WITH {t.PAIRS}, doc AS (SELECT doc_id, source, lang, text, list_distinct(regexp_extract_all(text, '\b[A-Z][A-Z0-9_]{{3,}}\b')) AS ids, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM documents),
c AS (SELECT vp.*, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS n FROM vp JOIN doc ON doc.doc_id = id JOIN doc q ON q.doc_id = query_id WHERE sim >= 0.2 AND length(q.body) >= 30)"""


@query(
    "r4_live_top_k",
    f"""{_RANKED}, s AS (SELECT c.query_id, c.id, b.body, sim, round(sim, 3) + CASE WHEN len(list_intersect(a.ids, b.ids)) > 0 THEN 0.08 ELSE 0 END + CASE WHEN a.lang = b.lang THEN 0.025 ELSE 0 END + CASE WHEN a.doc_id % 100 = 0 AND b.doc_id % 3 = 0 THEN 0.025 ELSE 0 END + CASE WHEN a.lang = b.lang AND a.source = b.source THEN 0.02 ELSE 0 END AS score FROM c JOIN doc a ON a.doc_id = query_id JOIN doc b ON b.doc_id = id WHERE n <= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY score DESC, sim DESC, id) AS k FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, id) AS nth FROM f WHERE k = 1)
SELECT query_id, id AS github_comment_id, nth, round(score, 6) AS score FROM g WHERE nth <= 5""",
)
def r4(spark, d):
    """Live retrieval with all bonuses: texts as they are, and paths of tests for some of the queries and past comments."""
    past = t.past_comments(spark, d)
    tested = lambda rest: F.when(rest, F.concat("source", F.lit("/tests/a."), "lang")).otherwise(F.concat("source", F.lit("/a."), "lang"))
    named = past.withColumnsRenamed({"repo_owner": "source", "repo_name": "lang"})
    asked = named.where("github_comment_id % 50 = 0").select(F.col("github_comment_id").alias("query_id"), F.col("diff_hunk").alias("hunk"), tested(F.col("github_comment_id") % 100 == 0).alias("path"), F.col("source").alias("repo_owner"), F.col("lang").alias("repo_name"), F.col("embedding").alias("vector"))
    past = named.withColumn("path", tested(F.col("github_comment_id") % 3 == 0)).withColumnsRenamed({"source": "repo_owner", "lang": "repo_name"})
    return retrieval.similar_comments(asked, past, 5, 0.2).select("query_id", "github_comment_id", "nth", F.round("score", 6).alias("score"))


@query(
    "j2_pool_before_cutoff",
    f"WITH {t.PAIRS}, n AS (SELECT vp.*, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS nth FROM vp JOIN documents q ON q.doc_id = query_id JOIN documents c ON c.doc_id = id WHERE id < query_id AND c.lang IN ('en', 'fr') AND sim >= 0.1 AND length(q.text) >= 30), b AS (SELECT n.*, row_number() OVER (PARTITION BY query_id, lower(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g')) ORDER BY nth) AS k FROM n JOIN documents c ON c.doc_id = id WHERE nth <= 5) SELECT query_id, id AS github_comment_id, nth, round(sim, 3) AS similarity FROM b WHERE k = 1",
)
def j2(spark, d):
    at = lambda c: F.timestamp_micros(F.col(c))
    past = t.past_comments(spark, d).withColumn("comment_created_at", at("github_comment_id"))
    asked = past.where("github_comment_id % 50 = 0").select(F.col("github_comment_id").alias("query_id"), F.col("diff_hunk").alias("hunk"), F.col("comment_created_at").alias("before_date"), F.col("embedding").alias("vector"))
    pool = past.where("repo_name in ('en', 'fr')").select("repo_owner", "repo_name").distinct()
    return retrieval.similar_comments_for_eval(asked, past, pool, 5, 0.1).select("query_id", "github_comment_id", "nth", "similarity")


@query("a12_best_neighbour", f"WITH {t.PAIRS} SELECT query_id, id, round(sim, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS n FROM vp WHERE query_id <> id AND sim > 0) WHERE n = 1")
def a12(spark, d):
    near = retrieval.top_similar(t.vector_queries(spark, d), t.vectors(spark, d), 50, exclude_self=True).drop("nth")
    return metrics.best_match(near, ["query_id"], "id").withColumn("similarity", F.round("similarity", 9))


@query("g1_first_of_each_body", r"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def g1(spark, d):
    return retrieval.first_ids(t.table(spark, d, "documents"), "text", "doc_id").select("doc_id")


@query("f2_pool_semi_join", "SELECT doc_id FROM documents WHERE (source, lang) IN (SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def f2(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "source", "lang")
    pool = docs.join(t.table(spark, d, "labels").where("toxic = 1"), "doc_id").select("source", "lang").distinct()
    return docs.join(pool, ["source", "lang"], "left_semi").select("doc_id")


@query("f3_temporal_cutoff", "SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS held_out FROM events GROUP BY event_type")
def f3(spark, d):
    comments = t.table(spark, d, "events").withColumn("comment_created_at", F.col("ts").cast("timestamp"))
    late = evalsplit.pool_sizes(evalsplit.held_out_pool(comments, datetime(2024, 1, 15), with_bots=True), ["event_type"])
    whole = evalsplit.pool_sizes(comments, ["event_type"]).withColumnRenamed("n_rows", "n")
    held = F.coalesce("n_rows", F.lit(0))
    return whole.join(late, "event_type", "left").select("event_type", (F.col("n") - held).alias("before"), held.alias("held_out"))


@query("f4_author_suffix", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%widget'")
def f4(spark, d):
    comments = t.table(spark, d, "part").withColumn("author", F.regexp_replace("p_name", "widget$", "[bot]")).withColumn("comment_created_at", F.lit(datetime(2024, 1, 15)))
    return evalsplit.held_out_pool(comments, datetime(2024, 1, 15)).select("p_partkey")


@query("f5_automated_content", "SELECT doc_id FROM documents WHERE NOT coalesce(contains(text, 'license') OR contains(text, 'token = '), false)")
def f5(spark, d):
    return t.table(spark, d, "documents").where(~text.contains_marker(F.col("text"), ["license", "token = "])).select("doc_id")


@query("f6_non_blank_hunks", r"SELECT lang, count(*) FILTER (regexp_replace(text, '^\s+|\s+$', '', 'g') <> '') AS not_blank, count(*) FILTER (text <> '') AS not_empty FROM documents GROUP BY lang")
def f6(spark, d):
    return t.table(spark, d, "documents").groupBy("lang").agg(F.count_if(text.strip(F.col("text")) != "").alias("not_blank"), F.count_if(F.col("text") != "").alias("not_empty"))


@query("f7_f8_length_gates", r"SELECT lang, count(*) FILTER (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 30) AS searched, count(*) FILTER (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 30) AS split FROM documents GROUP BY lang")
def f7(spark, d):
    return t.table(spark, d, "documents").groupBy("lang").agg(F.count_if(retrieval.long_enough(F.col("text"))).alias("searched"), F.count_if(F.length(text.strip(F.col("text"))) > 30).alias("split"))


# ---- corpus ----


@query("snk1_a16_ingest_accounting", "SELECT count(*) FILTER (l.doc_id IS NULL) AS ingested, count(*) FILTER (l.doc_id IS NOT NULL) AS skipped FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def snk1(spark, d):
    return corpus.accounting(t.table(spark, d, "documents").select("doc_id"), t.table(spark, d, "labels"), "doc_id")


@query("j5_new_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(spark, d):
    return corpus.new_rows(t.table(spark, d, "documents").select("doc_id"), t.table(spark, d, "labels"), "doc_id")


@query("snk7_f18_backfill", "SELECT d.doc_id, coalesce(CASE WHEN d.lang = 'en' THEN 1 END, l.quality)::INTEGER AS quality, (d.lang IS DISTINCT FROM 'en' AND l.quality IS NOT NULL) AS was_filled FROM documents d LEFT JOIN labels l USING (doc_id)")
def snk7(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", 1).alias("quality"))
    return corpus.backfilled(rows, t.table(spark, d, "labels"), "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("quality"), "was_filled")


@query("p2_p3_ingest_projection", f"WITH {t.EVENTS} SELECT event_id AS github_comment_id, user_id AS pr_number, 'src/' || event_type || '.py' AS path, CASE WHEN k > 50 THEN k ELSE k + 1 END::INTEGER AS line, event_type AS author, date_trunc('second', ts) AS comment_created_at FROM ev")
def p2(spark, d):
    e = t.events(spark, d)
    api = e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("https://api/repos/o/r/pulls/"), "user_id").alias("pull_request_url"), F.concat(F.lit("src/"), "event_type", F.lit(".py")).alias("path"), F.when(F.col("k") > 50, F.col("k")).alias("line"), (F.col("k") + 1).alias("original_line"),
        F.lit("@@").alias("diff_hunk"), F.lit("b").alias("body"), F.struct(F.col("event_type").alias("login")).alias("user"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit(None).cast("string").alias("html_url"),
    )
    return corpus.projected(api).select("github_comment_id", F.col("pr_number").cast("long").alias("pr_number"), "path", "line", "author", "comment_created_at")


# ---- metrics and evaluation ----

_MATCHED = "CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END"


@query("a1_tri_state_counts", f"SELECT count(*) AS total, count(*) FILTER ({_MATCHED}) AS tp, count(*) FILTER (NOT {_MATCHED}) AS fp, count(*) FILTER ({_MATCHED} IS NULL) AS open FROM lineitem")
def a1(spark, d):
    matched = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    return t.table(spark, d, "lineitem").agg(*metrics.match_counts(matched))


_PRF = "round(tp / nullif(tp + fp, 0), 3) AS precision, round(tp / nullif(tp + fn, 0), 3) AS recall"


@query("a2_a3_precision_recall_f1", f"WITH c AS (SELECT count(*) FILTER ({_MATCHED}) AS tp, count(*) FILTER (NOT {_MATCHED}) AS fp, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS fn FROM lineitem), p AS (SELECT *, {_PRF} FROM c) SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 3) AS f1 FROM p")
def a3(spark, d):
    fn = t.table(spark, d, "orders").where("o_orderstatus = 'P'").agg(F.count("*").alias("fn"))
    return metrics.precision_recall_f1(a1(spark, d).select("tp", "fp").crossJoin(fn))


@query("a3_f1_by_language", f"WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang), p AS (SELECT *, {_PRF} FROM c) SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 3) AS f1 FROM p")
def a3_by(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", "lang").join(t.table(spark, d, "labels"), "doc_id")
    return metrics.precision_recall_f1(rows.groupBy("lang").agg(F.count_if(F.expr("quality = 1 and toxic = 0")).alias("tp"), F.count_if(F.expr("quality = 1 and toxic = 1")).alias("fp"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("fn")))


@query("f9_scoped_metrics", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality = 0) AS fp, count(*) FILTER (quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) WHERE source = 'src0' AND lang = 'en'")
def f9(spark, d):
    rows = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id", "left").select(F.col("source").alias("repo_owner"), F.col("lang").alias("repo_name"), (F.col("quality") == 1).alias("matched"))
    return metrics.scoped(rows, "src0", "en").agg(*metrics.match_counts(F.col("matched")))


_SWEEP = f"""WITH {t.SAMPLES}, x AS (SELECT s.*, th.threshold FROM s CROSS JOIN (VALUES (0.45::DOUBLE), (0.5), (0.55), (0.6), (0.65), (0.7), (0.75)) th(threshold)),
h AS (SELECT *, had_retrieval AND num_concerns > 0 AS has_any, had_retrieval AND num_concerns > 0 AND best_similarity >= threshold AS hit FROM x),
c AS (SELECT threshold, sum(hit::INT)::BIGINT AS tp, sum(CASE WHEN hit THEN num_concerns - 1 WHEN has_any THEN num_concerns ELSE 0 END)::BIGINT AS fp, sum((NOT hit)::INT)::BIGINT AS fn FROM h GROUP BY threshold),
p AS (SELECT *, {_PRF} FROM c), f AS (SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 3) AS f1 FROM p)"""


@query("a4_a6_threshold_sweep", f"{_SWEEP} SELECT * FROM f")
def a6(spark, d):
    return metrics.sweep(t.samples(spark, d))


@query("a7_best_threshold", f"{_SWEEP} SELECT threshold AS floor, f1 FROM f ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1")
def a7(spark, d):
    return metrics.best_threshold(metrics.sweep(t.samples(spark, d)))


@query("a5_final_score", f"WITH {t.SAMPLES}, h AS (SELECT *, had_retrieval AND num_concerns > 0 AS has_any, had_retrieval AND num_concerns > 0 AND best_similarity >= 0.45 AND judge_confirmed AS hit FROM s), c AS (SELECT sum(hit::INT)::BIGINT AS tp, sum(CASE WHEN hit THEN num_concerns - 1 WHEN has_any THEN num_concerns ELSE 0 END)::BIGINT AS fp, sum((NOT hit)::INT)::BIGINT AS fn, 0.45::DOUBLE AS floor FROM h), p AS (SELECT *, {_PRF} FROM c) SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 3) AS f1 FROM p")
def a5(spark, d):
    return metrics.final_score(t.samples(spark, d), 0.45)


@query("a13_cold_start", f"WITH {t.SAMPLES} SELECT count(*) AS n_samples, count(*) FILTER (NOT had_retrieval) AS no_retrieval_match_count, round(count(*) FILTER (NOT had_retrieval) / count(*) * 100, 1) AS no_retrieval_match_pct FROM s")
def a13(spark, d):
    return metrics.cold_start(t.samples(spark, d))


@query("a14_pool_sizes", "SELECT o_orderpriority, count(*) AS n_rows FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderpriority")
def a14(spark, d):
    pool = t.table(spark, d, "orders").withColumnsRenamed({"o_orderdate": "comment_created_at", "o_orderpriority": "author"})
    return evalsplit.pool_sizes(evalsplit.held_out_pool(pool.withColumn("comment_created_at", F.col("comment_created_at").cast("timestamp")), datetime(1996, 1, 1)), ["author"]).withColumnRenamed("author", "o_orderpriority")


@query("g7_even_subsample", "WITH n AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders), i AS (SELECT unnest(range(0, 7)) AS i) SELECT DISTINCT o_orderkey, o_orderpriority FROM n JOIN i ON c <= 7 OR pos = floor(i * (c / 7.0::DOUBLE))")
def g7(spark, d):
    return evalsplit.even_subsample(t.table(spark, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 7).select("o_orderkey", "o_orderpriority")


@query(
    "g8_stratified_split",
    """WITH n AS (SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders),
h AS (SELECT *, CASE WHEN pos < c // 2 THEN 'tune' ELSE 'test' END AS part FROM n), m AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, part ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority, part) AS size, greatest(1, CASE part WHEN 'tune' THEN 15 ELSE 35 END // (SELECT count(DISTINCT o_orderpriority) FROM orders)) AS q FROM h)
SELECT DISTINCT o_orderkey, part FROM m JOIN (SELECT unnest(range(0, 35)) AS i) ON i < q AND (size <= q OR place = floor(i * (size / q::DOUBLE)))""",
)
def g8(spark, d):
    return evalsplit.stratified_split(t.table(spark, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "part")


# ---- ground truth ----


@query("j3_f10_band_join", f"WITH {t.PLACED} SELECT comment_id, count(*) AS n_candidates, min(prediction_id) AS first_prediction FROM pairs GROUP BY comment_id")
def j3(spark, d):
    pairs = groundtruth.candidate_pairs(t.comments_at_lines(spark, d), t.predictions_at_lines(spark, d), ["path"])
    return pairs.groupBy("comment_id").agg(F.count("*").alias("n_candidates"), F.min("prediction_id").alias("first_prediction"))


@query("j4_f11_f12_unmatched", f"WITH {t.PLACED} SELECT comment_id FROM cm WHERE path <> '' AND line IS NOT NULL AND comment_id NOT IN (SELECT comment_id FROM pairs)")
def j4(spark, d):
    return groundtruth.false_negatives(t.comments_at_lines(spark, d), t.predictions_at_lines(spark, d), ["path"]).select("comment_id")


JUDGED = f"""WITH {t.PLACED}, s AS (SELECT *, ((prediction_id * 31 + comment_id * 17) % 100) / 100.0::DOUBLE AS sim, (prediction_id + comment_id) % 2 = 0 AS same FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY sim DESC, prediction_id) AS n FROM s), b AS (SELECT *, n = 1 AND sim > 0 AND sim >= 0.45 AS best FROM r),
w AS (SELECT *, best AND same AS won, coalesce(max(CASE WHEN best THEN CASE WHEN same THEN 'same' ELSE 'different' END END) OVER (PARTITION BY comment_id), 'below_similarity_floor') AS reason FROM b),
v AS (SELECT *, CASE WHEN won THEN true WHEN NOT bool_or(won) OVER (PARTITION BY comment_id) THEN false END AS m FROM w), f AS (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY m DESC NULLS LAST, comment_id) AS k FROM v)"""


def _judged(spark, d):
    pairs = groundtruth.candidate_pairs(t.comments_at_lines(spark, d), t.predictions_at_lines(spark, d), ["path"])
    same = (F.col("prediction_id") + F.col("comment_id")) % 2 == 0
    pairs = pairs.withColumn("similarity", ((F.col("prediction_id") * 31 + F.col("comment_id") * 17) % 100) / F.lit(100.0)).withColumn("same_concern", same).withColumn("judge_reason", F.when(same, "same").otherwise("different"))
    return groundtruth.judged(pairs)


@query("st13_ground_truth_state", f"{JUDGED} SELECT prediction_id, m AS matched, CASE WHEN won THEN 'embedding+judge' END AS match_type, CASE WHEN won THEN comment_id END AS source_comment_id, CASE WHEN m IS NOT NULL THEN reason END AS match_reason FROM f WHERE k = 1")
def st13(spark, d):
    return _judged(spark, d)


@query("snk3_updated_predictions", f"{JUDGED} SELECT p.matched IS NULL AS was_open, coalesce(p.matched, f.m) AS matched, count(*) AS n FROM pr p LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (prediction_id) GROUP BY 1, 2")
def snk3(spark, d):
    p = t.predictions_at_lines(spark, d)
    return groundtruth.updated(p.withColumn("was_open", F.col("matched").isNull()), _judged(spark, d)).groupBy("was_open", "matched").agg(F.count("*").alias("n"))


@query("snk2_predictions", f"WITH {t.EVENTS} SELECT event_id AS pr_number, event_type || '.py' AS path, (k + 1)::INTEGER AS predicted_line, event_type AS concern, CASE WHEN k > 10 THEN value / 500 END AS confidence, NULL::BOOLEAN AS matched FROM ev")
def snk2(spark, d):
    source = F.array(F.struct(F.concat("event_type", F.lit(".py")).alias("path"), F.lit("x.py").alias("triggered_by_file"), F.format_string("@@ -1 +%d @@ f", F.col("k") + 1).alias("triggered_by_hunk")))
    finding = F.struct(source.alias("source_comments"), F.col("event_type").alias("concern"), F.when(F.col("k") > 10, F.col("value") / 500).alias("confidence"))
    rows = t.events(spark, d).select(F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"), F.col("event_id").alias("pr_number"), finding.alias("finding"))
    return groundtruth.predictions(rows).drop("repo_owner", "repo_name")


# ---- diffs ----


@query("a8_context_in_order", "SELECT conv_id, string_agg(text, chr(10) || '...' || chr(10) ORDER BY turn, text) AS context FROM conversations GROUP BY conv_id")
def a8(spark, d):
    return diff.joined_in_order(t.table(spark, d, "conversations"), ["conv_id"], "turn", "text")


_HUNKS = rf"WITH {t.DIFFS}, m AS (SELECT *, sum((starts_with(line, '@@'))::INT) OVER w AS nth, last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS) OVER w AS p FROM ln WINDOW w AS (PARTITION BY conv_id ORDER BY nr ROWS UNBOUNDED PRECEDING)), h AS (SELECT conv_id, nth, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT starts_with(line, '+++ b/')), '') AS hunk, coalesce(arg_max(p, nr), '') AS path FROM m WHERE nth > 0 GROUP BY conv_id, nth), hk AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY nth) - 1)::INTEGER AS pos, path, hunk FROM h WHERE length(regexp_replace(hunk, '^\s+|\s+$', '', 'g')) > 30)"


@query("t9_hunk_split", f"{_HUNKS} SELECT conv_id, pos, path, sha256(hunk) AS hunk_hash FROM hk")
def t9(spark, d):
    return diff.split_hunks(t.diffs(spark, d), "conv_id", "diff").select("conv_id", "pos", "path", F.sha2("hunk", 256).alias("hunk_hash"))


_COUNTS = f"WITH {t.DIFFS}, m AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY nr ROWS UNBOUNDED PRECEDING) AS path FROM ln), c AS (SELECT conv_id, path, min(nr) AS first_at, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS added, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS removed FROM m WHERE path IS NOT NULL GROUP BY conv_id, path)"


@query("a9_t5_line_counts", f"{_COUNTS} SELECT conv_id, path, added, removed, path LIKE '%/tests/%' AS is_test FROM c")
def a9(spark, d):
    return diff.line_counts(t.diffs(spark, d), "conv_id", "diff").drop("first_at")


@query("a9_diff_summary", f"{_COUNTS} SELECT conv_id, count(*)::INTEGER AS file_count, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, string_agg(path, ',' ORDER BY first_at) AS paths FROM c GROUP BY conv_id")
def a9_sum(spark, d):
    s = diff.summarize(diff.line_counts(t.diffs(spark, d), "conv_id", "diff"), "conv_id")
    return s.select("conv_id", "file_count", "added", "removed", F.array_join(F.transform("files", lambda x: x["path"]), ",").alias("paths"))


@query(
    "t27_change_overview",
    f"""{_COUNTS}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_at) AS nth, path LIKE '%/tests/%' AS is_test FROM c)
SELECT conv_id, '**Changed areas (' || count(*) || ' files; +' || sum(added)::BIGINT || '/-' || sum(removed)::BIGINT || ' lines):**' || chr(10) || string_agg('- `' || path || ' (+' || added || '/-' || removed || ')`', chr(10) ORDER BY nth) FILTER (nth <= 12)
  || CASE WHEN count(*) > 12 THEN chr(10) || '- `…and ' || (count(*) - 12) || ' more changed files`' ELSE '' END || chr(10)
  || CASE WHEN count(*) FILTER (is_test) > 0 THEN '**Test files changed:** ' || string_agg('`' || path || '`', ', ' ORDER BY nth) FILTER (is_test) ELSE '**Tests:** none are part of this diff, so run those that cover the code it touches.' END AS overview
FROM s GROUP BY conv_id""",
)
def t27(spark, d):
    s = diff.summarize(diff.line_counts(t.diffs(spark, d), "conv_id", "diff"), "conv_id")
    return s.select("conv_id", diff.overview(s).alias("overview"))


_ADDED = r"""al AS (SELECT conv_id, pos, hunk, unnest(string_split(hunk, chr(10))) AS line, generate_subscripts(string_split(hunk, chr(10)), 1) AS nr FROM hk),
cl AS (SELECT conv_id, pos, nr, substr(line, 2) AS x, regexp_replace(substr(line, 2), '^\s+|\s+$', '', 'g') AS bare FROM al WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')),
ql AS (SELECT *, contains(x, '"' || '""') OR contains(x, chr(39) || chr(39) || chr(39)) AS quoted FROM cl WHERE bare <> '' AND NOT regexp_matches(bare, '^(import |from |logger = |client = )') AND NOT contains(x, '= structlog')),
kl AS (SELECT conv_id, pos, x, nr FROM (SELECT *, coalesce(sum(quoted::INT) OVER (PARTITION BY conv_id, pos ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ql) WHERE NOT quoted AND before % 2 = 0),
nl AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY nr) AS nth FROM kl)"""


@query("t10_relevant_lines", f"{_HUNKS}, {_ADDED} SELECT hk.conv_id, hk.pos, coalesce(string_agg(x, chr(10) ORDER BY nth) FILTER (nth <= 8), '') || CASE WHEN count(nth) > 8 THEN chr(10) || '... (' || (count(nth) - 8) || ' more lines)' ELSE '' END AS preview FROM hk LEFT JOIN nl ON nl.conv_id = hk.conv_id AND nl.pos = hk.pos GROUP BY hk.conv_id, hk.pos")
def t10(spark, d):
    return diff.split_hunks(t.diffs(spark, d), "conv_id", "diff").select("conv_id", "pos", diff.relevant_lines(F.col("hunk")).alias("preview"))


@query("t8_starting_line", f"WITH {t.EVENTS} SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE k END::INTEGER AS start_line FROM ev")
def t8(spark, d):
    hunk = F.when(F.col("k") % 3 == 0, F.lit("@@ none")).when(F.col("k") % 3 == 1, F.format_string("@@ -1,6 +%d,9 @@ ctx", "k")).otherwise(F.format_string("@@ -1 +%d @@", "k"))
    return t.events(spark, d).select("event_id", diff.starting_line(hunk).alias("start_line"))


@query("r5_first_hunks", "SELECT conv_id, turn, n AS nth, c > 3 AS truncated FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE n <= 3")
def r5(spark, d):
    return diff.first_n(t.table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", [F.col("turn")], 3).select("conv_id", "turn", "nth", "truncated")


# ---- reviews ----


@query("f17_g6_calls_to_do", "WITH g AS (SELECT conv_id, turn, text FROM conversations WHERE (conv_id, text) NOT IN (SELECT conv_id, text FROM conversations WHERE role = 'system')), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id) AS c FROM g) SELECT conv_id, turn AS pos, nth, c > 4 AS truncated FROM n WHERE nth <= 4")
def g6(spark, d):
    g = t.table(spark, d, "conversations").withColumn("review_key", text.review_key(F.lit("p"), F.col("text")))
    done = g.where("role = 'system'").select(F.col("conv_id").alias("review_id"), "review_key")
    return reviews.to_do(g.select(F.col("conv_id").alias("review_id"), F.col("turn").alias("pos"), "review_key"), done, limit=4).select(F.col("review_id").alias("conv_id"), "pos", "nth", "truncated")


@query("r6_a11_group_order", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, role, text) - 1)::INTEGER AS pos, length(text)::DOUBLE AS max_rank FROM conversations")
def r6(spark, d):
    g = t.table(spark, d, "conversations").select(F.col("conv_id").alias("review_id"), "turn", F.col("role").alias("filepath"), F.col("text").alias("hunk"), F.array(F.lit(0.0), F.length("text").cast("double")).alias("scores"))
    return reviews.ordered_groups(g).select(F.col("review_id").alias("conv_id"), "turn", F.col("pos").cast("int").alias("pos"), "max_rank")


@query("a10_t14_distinct_evidence", "SELECT source, count(DISTINCT CASE WHEN lang = 'en' THEN 'u' || length(text) ELSE lang || chr(0) || text END) AS similar_count FROM documents GROUP BY source")
def a10(spark, d):
    docs = t.table(spark, d, "documents")
    rows = docs.select(F.col("source").alias("review_id"), F.when(F.col("lang") == "en", F.concat(F.lit("u"), F.length("text"))).alias("html_url"), F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"), F.col("lang").alias("path"), F.col("text").alias("body"))
    return reviews.distinct_evidence(rows).withColumnRenamed("review_id", "source")


@query("j8_context_of_clusters", "WITH c AS (SELECT source, lang, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id) AS context FROM documents GROUP BY source, lang), l AS (SELECT DISTINCT source, lang FROM documents) SELECT source, string_agg('FILE: ' || lang || chr(10) || context, chr(10) || chr(10) ORDER BY lang) AS changed_context FROM l JOIN c USING (source, lang) GROUP BY source")
def j8(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("source").alias("review_id"), F.col("lang").alias("path"), "doc_id", F.col("doc_id").cast("string").alias("id_text"))
    contexts = diff.joined_in_order(docs, ["review_id", "path"], "doc_id", "id_text", ";")
    groups = docs.groupBy("review_id").agg(F.array_sort(F.collect_set("path")).alias("filepaths")).withColumn("pos", F.lit(0))
    return reviews.with_context(groups, contexts).select(F.col("review_id").alias("source"), "changed_context")


@query("r7_latest_failures", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def r7(spark, d):
    return reviews.latest_failures(t.table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts"), "ts", "event_id")


@query("r8_due_queue", "SELECT event_id, CASE WHEN event_type <> 'signup' THEN ts END AS dispatched_at FROM events ORDER BY dispatched_at ASC NULLS FIRST, event_id LIMIT 100")
def r8(spark, d):
    q = t.table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "signup", F.col("ts")).alias("dispatched_at"))
    return reviews.due(q, "dispatched_at", "event_id")


@query("r9_chronological", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events")
def r9(spark, d):
    return t.table(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nth"))


@query("st9_latest_head", "WITH h AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS head FROM events GROUP BY user_id) SELECT event_id FROM events JOIN h USING (user_id) WHERE event_type = head")
def st9(spark, d):
    e = t.table(spark, d, "events")
    return reviews.current_only(e, reviews.latest_heads(e, ["user_id"], "event_type", "ts", "event_id"), ["user_id"], "event_type").select("event_id")


@query("snk4_dead_letters", "SELECT doc_id, left(text, 2000) AS error FROM documents")
def snk4(spark, d):
    return reviews.dead_letters(t.table(spark, d, "documents").select("doc_id", F.col("text").alias("error")))


@query("snk5_report_upsert", "WITH b AS (SELECT user_id, event_id, ts, (event_type = 'click')::INT AS new FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY new DESC, ts DESC) AS n FROM b) SELECT user_id AS head_sha, event_id FROM n WHERE n = 1")
def snk5(spark, d):
    e = t.table(spark, d, "events").select(F.col("user_id").alias("head_sha"), "event_id", F.col("ts").alias("posted_at"), "event_type")
    return reviews.published(e.where("event_type <> 'click'"), e.where("event_type = 'click'")).select("head_sha", "event_id")


_RUN = f"""WITH {t.EVENTS}, pool AS (SELECT *, event_type || '/p' || (user_id % 2) AS repo FROM ev WHERE ts >= TIMESTAMP '2024-01-15'),
pn AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY repo) AS c FROM pool),
ph AS (SELECT *, CASE WHEN pos < c // 2 THEN 'tune' ELSE 'test' END AS part FROM pn),
pm AS (SELECT *, row_number() OVER (PARTITION BY repo, part ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY repo, part) AS size, greatest(1, CASE part WHEN 'tune' THEN 15 ELSE 35 END // (SELECT count(DISTINCT repo) FROM pool)) AS q FROM ph),
sp AS (SELECT *, event_type <> 'error' AS had, value / 500 AS raw FROM pm WHERE size <= q OR EXISTS (SELECT 1 FROM range(0, 35) r(i) WHERE i < q AND place = floor(i * (size / q::DOUBLE)))),
sr AS (SELECT part, event_id AS sample_id, had AS had_retrieval, CASE WHEN had THEN user_id % 4 ELSE 0 END::INT AS num_concerns, CASE WHEN had AND user_id % 4 > 0 THEN round(raw::DECIMAL(20, 17), 3)::DOUBLE END AS best_similarity, raw, CASE WHEN had AND user_id % 4 > 0 THEN event_type END AS best_concern, props AS real_comment, k % 2 = 0 AS judge FROM sp),
th AS (SELECT unnest([0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75])::DOUBLE AS threshold),
tc AS (SELECT threshold, coalesce(sum(CASE WHEN best_similarity >= threshold THEN 1 ELSE 0 END), 0)::BIGINT AS tp, coalesce(sum(num_concerns - CASE WHEN best_similarity >= threshold THEN 1 ELSE 0 END), 0)::BIGINT AS fp, coalesce(sum(CASE WHEN best_similarity >= threshold THEN 0 ELSE 1 END), 0)::BIGINT AS fn FROM th, sr WHERE part = 'tune' GROUP BY threshold),
tp AS (SELECT *, {_PRF} FROM tc), tf AS (SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 3) AS f1 FROM tp),
fl AS (SELECT threshold AS floor FROM tf ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1),
ts AS (SELECT sample_id, had_retrieval, num_concerns, best_similarity, best_concern, real_comment, CASE WHEN num_concerns > 0 AND raw >= floor THEN judge END AS judge_confirmed, CASE WHEN num_concerns > 0 AND raw >= floor THEN 'k' END AS judge_reason, floor FROM sr, fl WHERE part = 'test'),
fc AS (SELECT floor, sum(hit)::BIGINT AS tp, sum(num_concerns - hit)::BIGINT AS fp, sum(1 - hit)::BIGINT AS fn, count(*) AS n, count(*) FILTER (NOT had_retrieval) AS bare FROM (SELECT *, CASE WHEN best_similarity >= floor AND judge_confirmed THEN 1 ELSE 0 END AS hit FROM ts) GROUP BY floor),
fp AS (SELECT *, {_PRF} FROM fc), ff AS (SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 3) AS f1 FROM fp)
SELECT to_json(struct_pack(run_at := '2024-06-01T00:00:00', split_date := '2024-01-15T00:00:00', repo_pool := (SELECT list(DISTINCT repo ORDER BY repo) FROM pool), pool_sizes_by_repo := (SELECT map_from_entries(list((repo, n) ORDER BY repo)) FROM (SELECT repo, count(*) AS n FROM pool GROUP BY repo)),
tune_size := (SELECT count(*) FROM sr WHERE part = 'tune'), test_size := n, tuning_sweep := (SELECT list(struct_pack(threshold := threshold, tp := tp, fp := fp, fn := fn, precision := precision, recall := recall, f1 := f1) ORDER BY threshold) FROM tf), floor_selected := floor,
final_metrics := struct_pack(floor := floor, tp := tp, fp := fp, fn := fn, precision := precision, recall := recall, f1 := f1), no_retrieval_match_count := bare, no_retrieval_match_pct := round(bare / n * 100, 1),
test_sample_results := (SELECT list(struct_pack(sample_id := sample_id, had_retrieval := had_retrieval, num_concerns := num_concerns, best_similarity := best_similarity, best_concern := best_concern, real_comment := real_comment, judge_confirmed := judge_confirmed, judge_reason := judge_reason) ORDER BY sample_id) FROM ts)))::VARCHAR AS artifact FROM ff"""


@query("snk6_run_artifact", _RUN)
def snk6(spark, d):
    """The whole record of a run: events from the split date on are the pool, their kinds and halves of users its repositories."""
    split_date, e = datetime(2024, 1, 15), t.events(spark, d)
    comments = e.withColumns({"comment_created_at": F.col("ts"), "repo_owner": F.col("event_type"), "repo_name": F.concat(F.lit("p"), F.col("user_id") % 2)})
    pool = evalsplit.held_out_pool(comments, split_date, with_bots=True)
    picked = evalsplit.stratified_split(pool, ["repo_owner", "repo_name"], ["comment_created_at", "event_id"])
    rows = settled(t.samples_of(picked).withColumn("judge_reason", F.lit("k")))
    tune = metrics.sample_results(rows.where("part = 'tune'"))
    floor = metrics.best_threshold(metrics.sweep(tune)).first().floor
    return artifacts.run_record(pool, tune, metrics.sample_results(rows.where("part = 'test'"), floor), datetime(2024, 6, 1), split_date)


@query("src3_rate_guard", f"WITH {t.EVENTS} SELECT event_id, (CASE WHEN k < 10 THEN greatest(0, user_id - 50) + 5 ELSE 0 END)::BIGINT AS wait_seconds FROM ev")
def src3(spark, d):
    return t.events(spark, d).select("event_id", reviews.rate_guard(F.col("k"), F.col("user_id"), F.lit(50)).alias("wait_seconds"))


@query("src2_next_page", "SELECT page_id, CASE WHEN page_id % 4 > 0 THEN url END AS next_url FROM pages")
def src2(spark, d):
    link = F.concat(F.lit('<http://a/prev>; rel="prev", <'), F.col("url"), F.when(F.col("page_id") % 4 > 0, '>; rel="next"').otherwise('>; rel="last"'))
    return t.table(spark, d, "pages").select("page_id", pages.next_page_url(link).alias("next_url"))


@query("src9_repositories", "SELECT n_nationkey AS id, n_name AS name, r_name AS owner FROM nation JOIN region ON n_regionkey = r_regionkey")
def src9(spark, d):
    n = t.table(spark, d, "nation").join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pages.repositories(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("login")).alias("owner")))


@query("src6_pull_states", "SELECT event_id AS pr_number, event_type AS head_sha, CASE WHEN value > 100 THEN 'open' ELSE 'closed' END AS state FROM events")
def src6(spark, d):
    e = t.table(spark, d, "events")
    return pages.pull_states(e.select(F.col("event_id").alias("number"), F.struct(F.col("event_type").alias("sha")).alias("head"), F.when(F.col("value") > 100, "open").otherwise("closed").alias("state")))


@query("src11_webhook_dispatch", f"WITH {t.EVENTS} SELECT event_id, CASE WHEN event_type = 'signup' THEN 'pong' WHEN event_type IN ('click', 'view') AND k % 3 < 2 THEN 'review' WHEN event_type = 'error' AND k % 3 = 2 THEN 'ground_truth' ELSE 'ignored' END AS kind, CASE WHEN event_type <> 'signup' THEN user_id END AS pr_number FROM ev")
def src11(spark, d):
    action = F.element_at(F.array(F.lit("opened"), F.lit("synchronize"), F.lit("created")), (F.col("k") % 3 + 1).cast("int"))
    payload = F.to_json(F.struct(action.alias("action"), F.when(F.col("event_type") != "signup", F.struct(F.col("user_id").alias("number"))).alias("pull_request")))
    event = F.when(F.col("event_type") == "signup", "ping").when(F.col("event_type").isin("click", "view"), "pull_request").when(F.col("event_type") == "error", "pull_request_review_comment").otherwise("push")
    rows = t.events(spark, d).select("event_id", event.alias("event"), F.lit("").alias("signature"), payload.alias("payload"))
    return webhooks.dispatched(rows).select("event_id", "kind", "pr_number")


_HMAC = "sha256(unhex('" + bytes(b ^ 0x5C for b in b"example secret".ljust(64, b"\0")).hex() + "') || unhex(sha256(unhex('" + bytes(b ^ 0x36 for b in b"example secret".ljust(64, b"\0")).hex() + "') || encode(props))))"


@query("t24_signed_webhooks", f"WITH {t.EVENTS} SELECT event_id, 'sha256=' || {_HMAC} AS signature, CASE WHEN k % 4 IN (1, 2, 3) THEN 'unauthorized' ELSE 'pong' END AS kind FROM ev")
def t24(spark, d):
    """Pings signed well, badly, not at all, and in capitals."""
    good = webhooks.signature(F.col("payload"), "example secret")
    e = t.events(spark, d).select("event_id", F.lit("ping").alias("event"), "k", F.col("props").alias("payload"))
    sent = F.when(F.col("k") % 4 == 0, good).when(F.col("k") % 4 == 1, F.concat(good, F.lit("0"))).when(F.col("k") % 4 == 2, F.upper(good))
    rows = webhooks.dispatched(e.withColumn("signature", sent), "example secret")
    return rows.select("event_id", good.alias("signature"), "kind")


# ---- findings ----


@query("g5_p4_evidence_budget", "WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations), s AS (SELECT *, 600 - coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (nth > 0)::INT AS room FROM n WHERE nth < 5) SELECT conv_id, turn, left(text, room::INT) AS text FROM s WHERE room > 0")
def g5(spark, d):
    return findings.within_budget(t.table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", [F.col("turn")], "text", 5, 600).select("conv_id", "turn", "text")


@query("f13_f15_j7_validated", f"WITH {t.EVENTS} SELECT event_id, event_type AS concern, CASE WHEN value <= 400 THEN value / 400 END AS confidence, k % 5 = 0 AS is_inference, CASE WHEN k % 4 < 2 THEN 'c' || (k % 4) || ',c1' ELSE 'c1' END AS sources FROM ev WHERE k % 7 > 0")
def f13(spark, d):
    concern = F.struct(F.concat(F.lit(" "), "event_type", F.lit("\n")).alias("concern"), F.when(F.col("k") % 7 > 0, F.col("props")).otherwise(" ").alias("evidence"), (F.col("value") / 400).alias("confidence"), (F.col("k") % 5 == 0).alias("is_inference"), F.array(F.col("k") % 4, F.lit(1), F.lit(-1), F.lit(9)).alias("source_indices"))
    rows = t.events(spark, d).select("event_id", F.to_json(F.struct(F.array(concern).alias("concerns"))).alias("reply"), F.array(F.lit("c0"), F.lit("c1")).alias("candidates"))
    return findings.validated(rows).select("event_id", "concern", "confidence", "is_inference", F.array_join("source_comments", ",").alias("sources"))


# Replies whose items have other types than asked for; of each event the number in its JSON picks one.
_TYPED = (
    '[{"concern": "c", "evidence": "e", "source_indices": ["0"]}]',
    '[{"concern": "c", "evidence": "e", "source_indices": [0], "is_inference": "true", "confidence": true}]',
    '[{"concern": 5, "evidence": "e", "source_indices": [0]}]',
    '[{"concern": {"a": 1}, "evidence": "e", "source_indices": [0]}]',
    '["bare", null, {"concern": " c\\n", "evidence": "e", "source_indices": [1], "confidence": 2}]',
    '[{"concern": "c", "evidence": "e", "source_indices": 0}]',
    '[{"concern": "c", "evidence": "e", "source_indices": [0, 1], "confidence": "0.25", "is_inference": true}]',
    '[{"concern": "c", "evidence": "e", "source_indices": [true, 1, 0.0, 7, -1], "confidence": []}, {"concern": "d", "evidence": 3, "source_indices": [0]}]',
    '{"concern": "c", "evidence": "e", "source_indices": [0]}',
)


@query("f13_f15_typed_replies", f"WITH {t.EVENTS} SELECT event_id, CASE k % 9 WHEN 4 THEN 2 ELSE 0 END::INTEGER AS reply_pos, 'c' AS concern, CASE k % 9 WHEN 1 THEN 1.0 WHEN 6 THEN 0.25 END::DOUBLE AS confidence, k % 9 = 6 AS is_inference, CASE k % 9 WHEN 1 THEN 'c0' WHEN 6 THEN 'c0,c1' ELSE 'c1' END AS sources FROM ev WHERE k % 9 IN (1, 4, 6, 7)")
def f13_typed(spark, d):
    reply = F.concat(F.lit('{"concerns": '), F.element_at(F.array(*map(F.lit, _TYPED)), (F.col("k") % 9 + 1).cast("int")), F.lit("}"))
    rows = t.events(spark, d).select("event_id", reply.alias("reply"), F.array(F.lit("c0"), F.lit("c1")).alias("candidates"))
    return findings.validated(rows).select("event_id", "reply_pos", "concern", "confidence", "is_inference", F.array_join("source_comments", ",").alias("sources"))


@query("t26_unreadable_reply", f"WITH {t.EVENTS} SELECT k % 3 AS cut, count(*) AS n_findings FROM ev WHERE k % 3 = 1 GROUP BY k % 3")
def t26(spark, d):
    """Of each three replies one lacks its end, one is whole and one is no JSON at all."""
    whole = F.lit('{"concerns": [{"concern": "c", "evidence": "e", "source_indices": [0]}]}')
    reply = F.when(F.col("k") % 3 == 0, F.substring(whole, 1, 60)).when(F.col("k") % 3 == 1, whole).otherwise(F.concat(F.lit("oops"), "props"))
    rows = t.events(spark, d).select((F.col("k") % 3).alias("cut"), reply.alias("reply"), F.array(F.lit("c")).alias("candidates"))
    return findings.validated(rows).groupBy("cut").agg(F.count("*").alias("n_findings"))


@query("f16_t11_t13_contradicted", "SELECT p_partkey, p_partkey % 2 = 0 AND length(regexp_replace(p_type, '[^A-Za-z]', '_', 'g')) >= 4 AS contradicted FROM part")
def f16(spark, d):
    """Concerns about an upper-case word of each part, against contexts that import and declare it or do not."""
    name = F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "_"))
    context = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("import { "), name, F.lit(" }\n from 'x';\nexport const "), name, F.lit(" = 1"))).otherwise(F.concat(F.lit("const "), name))
    return t.table(spark, d, "part").select("p_partkey", findings.contradicted(F.concat(name, F.lit(" is not defined")), context, context).alias("contradicted"))


_TOKENS = "tk AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "))) AS w FROM benchmark)"


@query("t2_t3_j9_token_jaccard", f"WITH {_TOKENS}, p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS common, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS every FROM tk a JOIN tk b ON a.item_id < b.item_id) SELECT a, b, round(common / every, 9) AS jaccard FROM p WHERE common > 0")
def t3(spark, d):
    w = t.table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    at = w.select("item_id", "size", F.explode("w").alias("word"))
    other = at.select(F.col("item_id").alias("b"), F.col("size").alias("size_b"), "word")
    both = at.join(other, "word").where("item_id < b").groupBy(F.col("item_id").alias("a"), "b", "size", "size_b").agg(F.count("*").alias("both"))
    return both.select("a", "b", F.round(F.col("both") / (F.col("size") + F.col("size_b") - F.col("both")), 9).alias("jaccard"))


_SETS = "tk AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))) AS w FROM documents)"


@query("j9_similar_documents", f"WITH {_SETS}, c AS (SELECT w, min(doc_id) AS class_id, count(*) AS members FROM tk WHERE len(w) > 0 GROUP BY w), u AS (SELECT class_id, members, len(w) AS n, unnest(w) AS t FROM c), p AS (SELECT a.class_id AS a, b.class_id AS b, any_value(b.members) AS far, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM u a JOIN u b ON a.t = b.t AND a.class_id <> b.class_id AND b.n >= 0.82 * a.n AND a.n >= 0.82 * b.n GROUP BY 1, 2), l AS (SELECT a, sum(far) AS linked FROM p WHERE jaccard >= 0.82 GROUP BY a) SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(members - 1 + coalesce(linked, 0), 0)::BIGINT AS n_links FROM tk LEFT JOIN c USING (w) LEFT JOIN l ON l.a = c.class_id")
def j9(spark, d):
    """Documents whose token sets have a Jaccard similarity of 0.82 or more."""
    docs = t.table(spark, d, "documents").select("doc_id", text.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return similar_sets(docs, "doc_id", "w")


@query("t1_identifiers", r"SELECT o_orderkey, array_to_string(list_distinct(regexp_extract_all(o_orderpriority, '\b[A-Z][A-Z0-9_]{3,}\b')).list_sort(), ',') AS ids FROM orders")
def t1(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(text.identifiers(F.col("o_orderpriority"))), ",").alias("ids"))


@query("t4_issue_families", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'missing_symbol' END, CASE WHEN p_partkey % 2 = 0 THEN 'type_information' END], lambda x: x IS NOT NULL), ',') AS families FROM part")
def t4(spark, d):
    claim = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " is Not Imported").otherwise(""), F.when(F.col("p_partkey") % 2 == 0, " lacks an explicit type").otherwise(""))
    return t.table(spark, d, "part").select("p_partkey", F.array_join(text.issue_families(claim), ",").alias("families"))


@query("g3_g4_a15_findings_merged")
def g3(spark, d):
    rows = t.table(spark, d, "conversations").select(F.col("conv_id").alias("review_id"), F.col("turn").cast("int").alias("pos"), F.col("text").alias("concern"), (F.col("role") == "user").alias("is_inference"), (F.length("text") / 5000).alias("confidence"), F.array("role").alias("source_key"))
    return findings.union_of_evidence(rows, findings.merged(rows))


_SYMBOLS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"


@query(
    "g2_clusters",
    f"""WITH RECURSIVE r AS (SELECT conv_id, turn::INTEGER AS pos, {_SYMBOLS} AS symbols, [role] AS evidence, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, i, pos, pos AS cluster_pos, [{{'pos': pos, 's': symbols, 'e': evidence}}] AS open FROM r WHERE i = 1
  UNION ALL SELECT conv_id, i, pos, coalesce(home, pos), CASE WHEN home IS NULL THEN list_append(open, {{'pos': pos, 's': symbols, 'e': evidence}}) ELSE list_transform(open, lambda c: CASE WHEN c.pos = home THEN {{'pos': c.pos, 's': list_distinct(list_concat(c.s, symbols)), 'e': list_distinct(list_concat(c.e, evidence))}} ELSE c END) END
  FROM (SELECT r.conv_id, r.i, r.pos, r.symbols, r.evidence, f.open, list_extract(list_filter(f.open, lambda c: list_has_any(c.s, r.symbols) AND list_has_any(c.e, r.evidence)), 1).pos AS home FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1))
SELECT conv_id AS review_id, pos, cluster_pos FROM f""",
)
def g2(spark, d):
    rows = t.table(spark, d, "conversations").select(F.col("conv_id").alias("review_id"), F.col("turn").cast("int").alias("pos"), text.tokens(F.col("text")).alias("symbols"), F.array("role").alias("evidence"))
    return findings.clusters(rows)


# ---- scalars ----


@query("t6_t7_paths", r"SELECT page_id, lower(regexp_extract(regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/]*)/*$', 1), '^.+(\.[^.]+)$', 1)) AS suffix, false AS is_test FROM pages")
def t6(spark, d):
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return t.table(spark, d, "pages").select("page_id", paths.suffix(path).alias("suffix"), paths.is_test_path(path).alias("is_test"))


@query("t7_language", "SELECT event_id, CASE event_type WHEN 'click' THEN 'python' WHEN 'view' THEN 'typescript' WHEN 'error' THEN '' ELSE 'yaml' END AS language FROM events")
def t7(spark, d):
    path = F.when(F.col("event_type") == "click", "a/b.py").when(F.col("event_type") == "view", "x.d.tsx").when(F.col("event_type") == "error", "Makefile").otherwise("c.yml")
    return t.table(spark, d, "events").select("event_id", paths.language(path).alias("language"))


@query("t15_review_key", "SELECT conv_id, turn, sha256(role || chr(0) || text) AS review_key FROM conversations")
def t15(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", text.review_key(F.col("role"), F.col("text")).alias("review_key"))


_CELL = r"regexp_replace(replace(replace(text, chr(10), ' '), '|', '\|'), '^\s+|\s+$', '', 'g')"


@query("t16_table_cell", f"SELECT doc_id, CASE WHEN length({_CELL}) > 90 THEN left({_CELL}, 90) || '...' ELSE {_CELL} END AS cell FROM documents")
def t16(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.table_cell(F.col("text")).alias("cell"))


@query("t17_t18_a17_formats", f"WITH {t.EVENTS} SELECT event_id, trunc(k / 100.0::DOUBLE * 100)::INTEGER || '%' AS confidence, k || ' hunk' || CASE WHEN k <> 1 THEN 's' ELSE '' END AS hunks, ((length(props) + 3) // 4)::BIGINT AS tokens FROM ev")
def t17(spark, d):
    return t.events(spark, d).select("event_id", text.truncated_percent(F.col("k") / F.lit(100.0)).alias("confidence"), text.plural(F.col("k"), "hunk").alias("hunks"), text.token_estimate(F.col("props")).alias("tokens"))


@query("t19_retry_after", f"WITH {t.EVENTS} SELECT event_id, (CASE k % 3 WHEN 0 THEN k WHEN 1 THEN 60 ELSE NULL END)::DOUBLE AS wait FROM ev")
def t19(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    header = F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).when(F.col("k") % 3 == 1, "Thu, 01 Feb 2024 00:01:00 GMT").otherwise("soon")
    return t.events(spark, d).select("event_id", retry.retry_after_seconds(header, now).alias("wait"))


@query("t20_backoff", f"WITH {t.EVENTS} SELECT event_id, least(60, 2 * pow(2, greatest(k % 9 - 1, 0)))::DOUBLE AS call, least(30, pow(2, k % 9))::DOUBLE AS delivery, least(30 * pow(2, k % 9), 180)::DOUBLE AS task, least(30 * pow(2, greatest(k % 9 - 1, 0)), 1800)::DOUBLE AS recovery FROM ev")
def t20(spark, d):
    n = F.col("k") % 9
    return t.events(spark, d).select("event_id", retry.full_jitter(n, 2, 60).alias("call"), retry.delivery_delay(n, 1, 30).alias("delivery"), retry.task_delay(n).alias("task"), retry.recovery_delay(n).alias("recovery"))


@query("t21_error_category", "SELECT event_id, CASE event_type WHEN 'click' THEN 'quota_exhausted' WHEN 'view' THEN 'authentication_or_permission' ELSE 'rate_limited' END AS category FROM events")
def t21(spark, d):
    code = F.when(F.col("event_type") == "click", "Insufficient_Quota").when(F.col("event_type") == "view", "invalid_api_key")
    return t.table(spark, d, "events").select("event_id", text.error_category(code, F.lit("tokens")).alias("category"))


@query("t22_t23_outcomes", f"WITH {t.EVENTS}, o AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'external_failure' WHEN k % 5 = 0 THEN 'partial_request_limit' WHEN k % 3 > 0 THEN 'completed_with_findings' WHEN k % 2 > 0 THEN 'completed_no_actionable_findings' ELSE 'general_analysis_only' END AS outcome FROM ev) SELECT *, CASE outcome WHEN 'completed_no_actionable_findings' THEN 'completed_no_findings' WHEN 'general_analysis_only' THEN outcome WHEN 'partial_request_limit' THEN outcome ELSE 'completed_with_findings' END AS status FROM o")
def t22(spark, d):
    outcome = text.outcome(F.col("event_type") == "error", F.col("k") % 5 == 0, F.col("k") % 3, F.col("k") % 2)
    return t.events(spark, d).select("event_id", outcome.alias("outcome"), text.durable_status(outcome).alias("status"))


@query("t28_reports")
def t28(spark, d):
    """A report for each conversation: assistant turns as findings, user turns as past comments."""
    c = t.table(spark, d, "conversations")
    source = F.struct(F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"), F.concat("role", F.lit(".py")).alias("path"), F.col("text").alias("body"), (F.length("text") % 100 / 100).alias("similarity"), F.lit("").alias("html_url"), F.lit("a.py").alias("triggered_by_file"), F.concat(F.lit("@@ -1,2 +3,4 @@\n+"), "text").alias("triggered_by_hunk"))
    past = c.where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", source.alias("s")))), lambda x: x["s"]).alias("source_comments"))
    f = F.struct("turn", F.col("text").alias("concern"), F.col("text").alias("evidence"), F.lit(0.5).alias("confidence"), F.lit("run the tests").alias("suggested_check"), (F.col("turn") % 3 == 0).alias("is_inference"), "source_comments")
    found = c.where("role = 'assistant'").join(past, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(f), lambda a, b: F.when(a["turn"] < b["turn"], -1).otherwise(1)).alias("findings"))
    whole = c.select("conv_id").distinct().join(found, "conv_id", "left")
    n = F.coalesce(F.size("findings"), F.lit(0))
    outcome = text.outcome(F.lit(False), F.lit(False), n, n)
    return whole.select("conv_id", report.marked(report.report(F.col("findings"), n, n, outcome, F.lit(False), F.lit(""), F.lit("")), F.col("conv_id").cast("string")).alias("body"))


# ---- clients ----


@query("src7_comments_of_a_pull", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id = 7")
def src7(spark, d):
    url = F.concat(F.lit("https://host/repos/o/"), "event_type", F.lit("/pulls/"), "user_id")
    return pages.comments_of_pull(t.table(spark, d, "events").withColumn("pull_request_url", url), "o", "view", 7).select("event_id")


@query("t25_query_value", r"WITH u AS (SELECT page_id, url, regexp_extract(url, '^[^#]*') AS rest, regexp_extract(url, '#.*$') AS fragment FROM pages), q AS (SELECT *, regexp_extract(rest, '^[^?]*') AS base, CASE WHEN instr(rest, '?') > 0 THEN list_transform(string_split(substr(rest, instr(rest, '?') + 1), '&'), lambda p: CASE WHEN starts_with(p, 'ref=') THEN 'ref=new' ELSE p END) ELSE [] END AS pairs FROM u) SELECT page_id, CASE WHEN starts_with(url, 'https:') THEN base || '?' || array_to_string(CASE WHEN list_contains(pairs, 'ref=new') THEN pairs ELSE list_append(pairs, 'ref=new') END, '&') || fragment ELSE url END AS url FROM q")
def t25(spark, d):
    return t.table(spark, d, "pages").select("page_id", pages.with_query_value(F.col("url"), "ref", "new", "https").alias("url"))


@query("st12_cooldown", f"WITH {t.EVENTS}, a AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS sec, CASE WHEN event_type = 'error' THEN k * 600 END AS pause, ts FROM ev) SELECT event_id, greatest(coalesce(max(sec + coalesce(pause, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - sec, 0), 0)::BIGINT AS wait FROM a")
def st12(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    pause = F.when(F.col("event_type") == "error", F.col("k") * 600)
    return t.events(spark, d).select("event_id", retry.cooldown_remaining(at, pause, ["user_id"], [F.col("ts"), F.col("event_id")]).cast("long").alias("wait"))
