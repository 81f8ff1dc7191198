"""The three ways through the engine: ingest comments, review a change, and evaluate on held-out comments."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.functions import text
from sparkloom.functions.vectors import cosine_similarity
from sparkloom.operators import corpus, diff, evalsplit, findings, metrics, report, retrieval, reviews
from sparkloom.operators.providers import Embedder, Judge, embedded, judged_pairs


def ingest(api_comments: DataFrame, existing: DataFrame, embed: Embedder, owner: str, repo: str, markers: list[str] = corpus.DEFAULT_MARKERS, public: bool = False) -> DataFrame:
    """Rows to append to the corpus: projected, filtered, new, and only then embedded."""
    rows = corpus.worth_keeping(corpus.projected(api_comments, public), markers, public=public)
    new = corpus.new_rows(rows, existing, "github_comment_id")
    return embedded(new.withColumn("repo_owner", F.lit(owner)).withColumn("repo_name", F.lit(repo)), "diff_hunk", embed)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, so that providers are not asked again: in the checkpoint folder, or in two copies without one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK_2)


def review(changes: DataFrame, comments: DataFrame, embed: Embedder, synthesize, threshold: float = retrieval.SIMILARITY, completed: DataFrame | None = None) -> DataFrame:
    """A row a review of ``changes`` (review_id long, repo_owner, repo_name, head_sha, diff): findings, outcome and body.

    ``synthesize`` answers a list of dicts (hunk, comments, changed_context) with JSON replies or None. Hunks are capped
    and embedded, similar past comments ranked, repeated evidence clustered, the best clusters synthesized within the
    call cap, replies validated, contradicted claims dropped and near-duplicates merged.
    """
    hunks = diff.split_hunks(changes, "review_id", "diff")
    capped = reviews.capped_hunks(hunks)
    asked = capped.join(changes.drop("diff"), "review_id").withColumn("query_id", F.col("review_id") * 1000 + F.col("pos"))
    hits = retrieval.similar_comments(settled(embedded(asked, "hunk", embed, "vector")), comments, threshold=threshold)
    source = F.struct("repo_owner", "repo_name", "path", "body", "similarity", F.col("html_url"), F.col("target_path").alias("triggered_by_file"), F.col("target_hunk").alias("triggered_by_hunk"))
    key = text.source_key(F.col("html_url"), F.col("repo_owner"), F.col("repo_name"), F.col("path"), F.col("body"))
    per_hunk = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("nth", source.alias("s"), "score", key.alias("k")))).alias("m"))
    groups = asked.join(per_hunk, "query_id").select(
        "review_id", F.col("path").alias("filepath"), "hunk", F.transform("m", lambda x: x["s"]).alias("matches"), F.transform("m", lambda x: x["score"]).alias("scores"), F.transform("m", lambda x: x["k"]).alias("evidence"), text.identifiers(F.col("hunk")).alias("symbols")
    )
    placed = reviews.ordered_groups(groups)
    homes = findings.clusters(placed)
    members = placed.join(homes, ["review_id", "pos"])
    part = F.when(F.col("pos") == F.col("cluster_pos"), F.col("hunk")).otherwise(F.concat(F.lit("--- Related changed hunk: "), F.col("filepath"), F.lit(" ---\n"), F.col("hunk")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("v")))), lambda x: x["v"])
    clustered = members.groupBy("review_id", F.col("cluster_pos").alias("pos")).agg(
        F.array_join(ordered(part), "\n\n").alias("hunk"), F.array_distinct(ordered(F.col("filepath"))).alias("filepaths"), F.array_distinct(F.flatten(ordered(F.col("matches")))).alias("matches"), F.min_by("review_key", "pos").alias("review_key"),
    )
    contexts = diff.joined_in_order(capped, ["review_id", "path"], "pos", "hunk")
    units = reviews.with_context(clustered, contexts)
    done = completed if completed is not None else units.select("review_id", "review_key").limit(0)
    todo = reviews.to_do(units, done)
    lines = F.transform(F.slice("matches", 1, findings.MAX_COMMENTS), lambda m, i: text.evidence_line(i, m["similarity"], m["body"], m["path"]))
    requests = todo.select("review_id", "pos", "hunk", F.to_json(lines).alias("comments"), F.left(F.col("changed_context"), F.lit(findings.MAX_CONTEXT)).alias("changed_context"), F.slice("matches", 1, findings.MAX_COMMENTS).alias("candidates"), "truncated")
    kinds = ", ".join(f"`{n}` {k}" for n, k in requests.dtypes)
    replies = settled(findings.synthesized(requests, synthesize, kinds, ["hunk", "comments", "changed_context"]))
    said = findings.validated(replies.where("not failed")).select("review_id", "pos", "reply_pos", "concern", "evidence", "confidence", "suggested_check", "is_inference", "source_comments")
    every = capped.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hunk"))), lambda x: x["hunk"]), "\n").alias("every"))
    mine = said.join(every, "review_id").join(clustered.select("review_id", "pos", "hunk"), ["review_id", "pos"])
    kept = mine.where(~findings.contradicted(F.col("concern"), F.col("hunk"), F.col("every"))).drop("every", "hunk")
    kept = kept.withColumn("pos", F.row_number().over(Window.partitionBy("review_id").orderBy("pos", "reply_pos")) - 1).drop("reply_pos")
    keyed = kept.withColumn("source_key", F.transform("source_comments", lambda s: text.source_key(s["html_url"], s["repo_owner"], s["repo_name"], s["path"], s["body"])))
    merged = findings.union_of_evidence(keyed, findings.merged(keyed))
    sources = keyed.join(findings.merged(keyed), ["review_id", "pos"]).groupBy("review_id", F.col("kept_pos").alias("pos")).agg(F.array_distinct(F.flatten(F.collect_list("source_comments"))).alias("source_comments"))
    final = keyed.drop("confidence", "source_comments", "source_key").join(merged.select("review_id", "pos", "confidence"), ["review_id", "pos"]).join(sources, ["review_id", "pos"])
    one = F.struct("pos", "concern", "evidence", "confidence", "suggested_check", "is_inference", "source_comments")
    found = final.groupBy("review_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)).alias("findings"))
    similar = members.select("review_id", F.explode("evidence").alias("k")).groupBy("review_id").agg(F.count_distinct("k").alias("similar_count"))
    failures = replies.groupBy("review_id").agg(F.bool_or("failed").alias("failed"), F.bool_or("truncated").alias("cut"))
    scanned = capped.groupBy("review_id").agg(F.count("*").alias("hunks_scanned"), F.bool_or("truncated").alias("capped"))
    whole = changes.select("review_id", "head_sha")
    for other in (found, similar, failures, scanned):
        whole = whole.join(other, "review_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    n_similar, n_hunks = F.coalesce("similar_count", F.lit(0)), F.coalesce("hunks_scanned", F.lit(0))
    partial = flag("cut") | flag("capped")
    outcome = text.outcome(flag("failed"), partial, F.coalesce(F.size("findings"), F.lit(0)), n_similar)
    summary = diff.summarize(diff.line_counts(changes, "review_id", "diff"), "review_id")
    overview = summary.select("review_id", diff.overview(summary).alias("overview"))
    whole = whole.join(overview, "review_id", "left").withColumn("outcome", outcome).withColumn("partial", partial)
    body = report.report(F.col("findings"), n_similar, n_hunks, F.col("outcome"), F.col("partial"), F.lit(""), F.when(F.coalesce(F.size("findings"), F.lit(0)) == 0, F.col("overview")))
    return whole.select("review_id", "head_sha", "findings", n_similar.alias("similar_count"), n_hunks.alias("hunks_scanned"), "outcome", text.durable_status(F.col("outcome")).alias("status"), "partial", report.marked(body, F.col("head_sha")).alias("body"))


def evaluate(comments: DataFrame, split_date, embed: Embedder, concerns, judge: Judge | None = None, **sizes) -> dict[str, DataFrame]:
    """Held-out evaluation: {"samples", "sweep", "floor", "final", "cold_start", "pool"}.

    Comments from ``split_date`` on are split into tune and test; retrieval sees only what came before. ``concerns`` is a
    function of the retrieved rows (query_id, body, ...) giving (query_id, concern). The floor is tuned on similarity
    alone; the test score also needs the judge, who is asked of test samples that reach the floor and of no others.
    ``samples`` are ``metrics.sample_results`` with ``part``; ``artifacts.run_record`` makes the record of a run of them.
    """
    pool = evalsplit.held_out_pool(comments, split_date)
    picked = evalsplit.stratified_split(pool, ["repo_owner", "repo_name"], ["comment_created_at", "github_comment_id"], **sizes)
    asked = picked.select(F.col("github_comment_id").alias("query_id"), F.col("diff_hunk").alias("hunk"), F.lit(split_date).cast("timestamp").alias("before_date"), F.col("embedding").alias("vector"), "part", F.col("body").alias("real_comment"))
    hits = retrieval.similar_comments_for_eval(asked, comments, comments.select("repo_owner", "repo_name").distinct())
    said = settled(embedded(concerns(hits), "concern", embed, "concern_vector")).join(embedded(asked.select("query_id", "real_comment"), "real_comment", embed, "body_vector"), "query_id")
    scored = said.withColumn("similarity", cosine_similarity(F.col("concern_vector"), F.col("body_vector"))).drop("concern_vector", "body_vector")
    best = settled(metrics.best_match(scored, ["query_id"], "concern"))
    counts = scored.groupBy("query_id").agg(F.count("*").cast("int").alias("num_concerns"))
    found = (
        asked.select("query_id", "part", "real_comment").join(hits.select("query_id").distinct().withColumn("had_retrieval", F.lit(True)), "query_id", "left").join(counts, "query_id", "left")
        .join(best.select("query_id", F.col("similarity").alias("best_similarity"), F.col("concern").alias("best_concern")), "query_id", "left")
    )
    unjudged = {"judge_confirmed": F.lit(None).cast("boolean"), "judge_reason": F.lit(None).cast("string")}
    tune = metrics.sample_results(found.where("part = 'tune'").withColumns(unjudged))
    swept = metrics.sweep(tune)
    floor = metrics.best_threshold(swept)
    least, test = floor.first().floor, found.where("part = 'test'")
    if judge:
        close = best.where(F.col("similarity") >= least).join(test.select("query_id"), "query_id", "left_semi")
        judged = settled(judged_pairs(close, judge, "concern", "real_comment"))
        test = test.join(judged.select("query_id", F.col("same_concern").alias("judge_confirmed"), "judge_reason"), "query_id", "left")
    else:
        test = test.withColumns(unjudged)
    test = metrics.sample_results(test, least)
    return {"samples": tune.unionByName(test), "sweep": swept, "floor": floor, "final": metrics.final_score(test, least), "cold_start": metrics.cold_start(test), "pool": pool}
