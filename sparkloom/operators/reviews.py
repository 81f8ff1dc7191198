"""The plan of a review: groups in order, contexts, what is done already, and the call cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import text
from sparkloom.operators.diff import first_n

MAX_HUNKS, MAX_CALLS = 50, 12


def capped_hunks(hunks: DataFrame, key: str = "review_id", limit: int = MAX_HUNKS) -> DataFrame:
    return first_n(hunks, key, [F.col("pos")], limit)


def ordered_groups(groups: DataFrame, key: str = "review_id") -> DataFrame:
    """``groups`` (key, filepath, hunk, scores) with max_rank, review_key and pos: best first, then path and hunk."""
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    order = Window.partitionBy(key).orderBy(F.desc("max_rank"), "filepath", "hunk")
    return groups.withColumn("max_rank", best).withColumn("review_key", text.review_key(F.col("filepath"), F.col("hunk"))).withColumn("pos", F.row_number().over(order) - 1)


def distinct_evidence(matches: DataFrame, key: str = "review_id") -> DataFrame:
    k = text.source_key(F.col("html_url"), F.col("repo_owner"), F.col("repo_name"), F.col("path"), F.col("body"))
    return matches.groupBy(key).agg(F.count_distinct(k).alias("similar_count"))


def with_context(clusters: DataFrame, contexts: DataFrame, key: str = "review_id") -> DataFrame:
    """``clusters`` (key, pos, filepaths) with the contexts (key, path, context) of their files, in order, under headers."""
    at = clusters.select(key, "pos", F.posexplode("filepaths").alias("nth", "path"))
    part = F.concat(F.lit("FILE: "), F.col("path"), F.lit("\n"), F.coalesce("context", F.lit("")))
    joined = at.join(contexts, [key, "path"], "left").groupBy(key, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("changed_context"))
    return clusters.join(joined, [key, "pos"], "left")


def to_do(groups: DataFrame, completed: DataFrame, key: str = "review_id", limit: int = MAX_CALLS) -> DataFrame:
    """Groups not yet completed (by review_key), as many as the cap allows, with ``truncated`` if it cuts any."""
    left = groups.join(completed.select(key, "review_key").distinct(), [key, "review_key"], "left_anti")
    return first_n(left, key, [F.col("pos")], limit)


def latest_heads(events: DataFrame, by: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """The last ``value`` of each key by time."""
    return events.groupBy(*by).agg(F.max_by(value, F.struct(ts, tie)).alias("head"))


def current_only(events: DataFrame, heads: DataFrame, by: list[str], value: str) -> DataFrame:
    """Events that still carry the head of their key; checked before the work and again before publishing."""
    return events.join(heads, by).where(F.col(value) == F.col("head")).drop("head")


def latest_failures(failures: DataFrame, ts: str, tie: str, limit: int = 50) -> DataFrame:
    return failures.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def due(queue: DataFrame, dispatched: str, tie: str, limit: int = 100) -> DataFrame:
    return queue.orderBy(F.asc_nulls_first(dispatched), tie).limit(limit)


def dead_letters(failures: DataFrame, error: str = "error") -> DataFrame:
    return failures.withColumn(error, F.substring(error, 1, 2000))


def published(existing: DataFrame, new: DataFrame, key: str = "head_sha") -> DataFrame:
    """One report a head: a new body replaces the one there, the latest of several counts."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc("posted_at"))
    return both.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth", "__new")


def rate_guard(remaining: Column, reset_at: Column, now: Column, floor: int = 10, margin: int = 5) -> Column:
    """Seconds a source has to pause: none while ``floor`` calls or more remain."""
    left = F.coalesce(remaining, F.lit(1))
    return F.when(left < floor, F.greatest(F.lit(0), F.coalesce(reset_at, F.lit(0)) - now) + margin).otherwise(F.lit(0)).cast("long")
