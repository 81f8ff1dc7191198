"""The corpus of past comments: projection, filters, insert-if-absent and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import text
from sparkloom.sinks import keyed

# What marks comments that a tool has written is given by the caller; these are the usual ones.
DEFAULT_MARKERS = ["<!-- automated-review -->", "[automated review]"]


def projected(comments: DataFrame, public: bool = False) -> DataFrame:
    """Comments as the REST source gives them, as corpus rows without an embedding.

    The pull request is the last part of its url (0 if a public one has none); the line falls back to the original one
    for private sources, the author to "unknown" for public ones; times are UTC without a zone.
    """
    number = F.element_at(F.split("pull_request_url", "/"), -1).try_cast("int")
    login = F.col("user.login")
    empty = (lambda c: F.coalesce(c, F.lit(""))) if public else (lambda c: F.col(c))
    return comments.select(
        F.col("id").cast("long").alias("github_comment_id"), (F.coalesce(number, F.lit(0)) if public else number).alias("pr_number"), empty("path").alias("path"),
        (F.col("line") if public else F.coalesce(F.nullif("line", F.lit(0)), "original_line")).cast("int").alias("line"), empty("diff_hunk").alias("diff_hunk"), empty("body").alias("body"),
        (F.coalesce(login, F.lit("unknown")) if public else login).alias("author"), utc(F.col("created_at")).alias("comment_created_at"), "html_url",
    )


def utc(c: Column) -> Column:
    """ISO 8601 text with a zone as a UTC time without one."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(c).cast("timestamp_ntz"))


def worth_keeping(comments: DataFrame, markers: list[str] = DEFAULT_MARKERS, body: str = "body", hunk: str = "diff_hunk", public: bool = False) -> DataFrame:
    """Without automated content, and without rows whose hunk is empty (private sources: blank)."""
    there = F.coalesce(F.col(hunk) != "" if public else text.strip(F.col(hunk)) != "", F.lit(False))
    return comments.where(~text.contains_marker(F.col(body), markers) & there)


def new_rows(fetched: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row for each key of ``fetched`` that ``existing`` lacks. Keys are compared before anything is embedded."""
    return fetched.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def accounting(fetched: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(ingested, skipped): skipped rows are known already or repeat a key."""
    counts = new_rows(fetched, existing, key).agg(F.count("*").alias("ingested"))
    return counts.crossJoin(fetched.agg(F.count("*").alias("n"))).select("ingested", (F.col("n") - F.col("ingested")).alias("skipped"))


def insert_if_absent(fetched: DataFrame, path: str, key: str, buckets: int = 64) -> DataFrame:
    """Adds what the keyed table at ``path`` lacks (``sinks.keyed``); returns what was ingested and skipped. Twice is as once."""
    done = keyed.upsert(fetched, path, [key], "absent", buckets)
    return fetched.sparkSession.createDataFrame([(done["inserted"], done["skipped"])], "ingested long, skipped long")


def backfilled(rows: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` filled from ``incoming`` where it is null, and ``was_filled``."""
    new = incoming.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("__new"))
    filled = F.col(column).isNull() & F.col("__new").isNotNull()
    return rows.join(new, key, "left").withColumn("was_filled", filled).withColumn(column, F.coalesce(column, "__new")).drop("__new")
