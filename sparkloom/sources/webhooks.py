"""Webhook events: signatures and dispatch."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

PULL = "struct<action: string, before: string, after: string, repository: struct<name: string, owner: struct<login: string>>, pull_request: struct<number: long, head: struct<sha: string>>, comment: struct<id: long, path: string, line: int, body: string>>"


def signature(payload: Column, secret: str) -> Column:
    """HMAC-SHA256 of ``payload`` as services send it. Two hashes in the JVM over the padded key; a null payload is empty."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(F.coalesce(payload, F.lit("")), "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, first), 256))


def signed(payload: Column, sent: Column, secret: str) -> Column:
    """Whether ``sent`` is the payload's signature; an empty secret accepts everything. What is compared are hashes of both, so the
    time it takes tells nothing about the signature."""
    if not secret:
        return F.lit(True)
    return F.sha2(F.coalesce(sent, F.lit("")), 256) == F.sha2(signature(payload, secret), 256)


def dispatched(events: DataFrame, secret: str = "", payload: str = "payload") -> DataFrame:
    """``events`` (event, signature, payload) with ``kind``: pong, review, ground_truth, ignored or unauthorized.

    For reviews and comments also owner, repo, pr_number, head_sha, allow_reclaim, before_sha, after_sha and comment.
    """
    rows = events.withColumn("p", F.from_json(payload, PULL)).withColumn("ok", signed(F.col(payload), F.col("signature"), secret))
    action = F.col("p.action")
    return rows.withColumn("kind", kind(F.col("ok"), F.col("event"), action)).select(
        *events.columns, "kind", F.col("p.repository.owner.login").alias("owner"), F.col("p.repository.name").alias("repo"), F.col("p.pull_request.number").alias("pr_number"), F.col("p.pull_request.head.sha").alias("head_sha"),
        action.isin("reopened", "synchronize").alias("allow_reclaim"), F.when(action == "synchronize", F.col("p.before")).alias("before_sha"), F.when(action == "synchronize", F.col("p.after")).alias("after_sha"), F.col("p.comment").alias("comment"),
    )


def kind(ok: Column, event: Column, action: Column) -> Column:
    return (
        F.when(~ok, "unauthorized").when(event == "ping", "pong").when((event == "pull_request") & action.isin("opened", "reopened", "synchronize"), "review")
        .when((event == "pull_request_review_comment") & (action == "created"), "ground_truth").otherwise("ignored")
    )
