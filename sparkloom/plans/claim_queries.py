"""Queries of review claims: the state machine over a table, with timers, and over a stream, against one recursive SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.plans import tables as t
from sparkloom.plans.registry import query
from sparkloom.streaming import claims, heads, running

_LIVE = "('queued', 'expired', 'abandoned')"


def claim_sql(events: str, until: str | None = None) -> str:
    """CTEs that end in ``outcomes``: what became of each row of the CTE ``events`` (key, seq, m, action, task, worker, value, reclaim,
    redel), one recursion step an event or, up to ``until``, a timer."""
    wake = f"CASE WHEN status = 'processing' THEN greatest(lease, clock) WHEN status IN {_LIVE} THEN greatest(clock, least(CASE WHEN dat IS NULL THEN clock ELSE dat + 1800 + 60 END, resume)) END" if until else "NULL::DOUBLE"
    freed = "('finished', 'retried', 'deferred', 'failed', 'lost', 'spent', 'closed', 'superseded', 'abandoned', 'queued', 'requeued')"
    return f"""{events}, numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY m, seq) AS i FROM raw_events {f'WHERE m <= {until}' if until else ''}),
run AS (
  SELECT DISTINCT key, 0::BIGINT AS i, NULL::VARCHAR AS status, NULL::VARCHAR AS task, NULL::VARCHAR AS owner, NULL::DOUBLE AS lease, NULL::BIGINT AS att, NULL::BIGINT AS disp, NULL::DOUBLE AS dat, NULL::BIGINT AS defs, NULL::DOUBLE AS since, NULL::DOUBLE AS resume, NULL::DOUBLE AS clock,
    NULL::BIGINT AS seq, NULL::DOUBLE AS m, NULL::VARCHAR AS action, 'start' AS does, NULL::VARCHAR AS value FROM numbered
  UNION ALL
  SELECT key, i + (NOT timer)::INT,
    CASE WHEN does IN ('queued', 'requeued', 'retried', 'deferred') THEN 'queued' WHEN does = 'acquired' THEN 'processing' WHEN does = 'finished' THEN CASE WHEN new_value IN ('completed_with_findings', 'completed_no_findings', 'general_analysis_only', 'partial_request_limit') THEN new_value ELSE 'completed_with_findings' END
      WHEN does IN ('failed', 'lost', 'never', 'spent') THEN 'failed' WHEN does = 'closed' THEN 'skipped_closed' WHEN does IN ('superseded', 'abandoned', 'expired') THEN does ELSE status END,
    CASE WHEN does = 'acquired' THEN new_task WHEN does IN {freed} THEN NULL ELSE task END, CASE WHEN does = 'acquired' THEN worker WHEN does IN {freed} THEN NULL ELSE owner END, CASE WHEN does = 'acquired' THEN now + 1200 WHEN does IN {freed} THEN NULL ELSE lease END,
    CASE WHEN does IN ('queued', 'requeued') THEN 0 WHEN does = 'acquired' THEN att + 1 ELSE att END, CASE WHEN does = 'queued' THEN 1 WHEN does = 'requeued' THEN 0 WHEN does IN ('expired', 'dispatched') THEN disp + 1 ELSE disp END,
    CASE WHEN does IN ('queued', 'retried', 'deferred', 'expired', 'dispatched') THEN now WHEN does IN ('requeued', 'unpublished') THEN NULL WHEN does = 'abandoned' THEN now - 1800 - 60 + least(30.0::DOUBLE * pow(2, greatest(0, att - 1)), 1800) ELSE dat END,
    CASE WHEN does IN ('queued', 'requeued') THEN 0 WHEN does = 'deferred' THEN defs + 1 ELSE defs END, CASE WHEN does IN ('queued', 'requeued') THEN NULL WHEN does = 'deferred' THEN coalesce(since, now) ELSE since END,
    CASE WHEN does = 'deferred' THEN now + greatest(1, ceil(wait)) WHEN does IN ('acquired', 'queued', 'requeued', 'resumed') THEN NULL ELSE resume END,
    CASE WHEN status IS NULL AND does <> 'queued' THEN NULL ELSE greatest(now, coalesce(clock, now)) END, CASE WHEN NOT timer THEN new_seq END, now, CASE WHEN timer THEN 'timer' ELSE new_action END, does, new_value
  FROM (SELECT *, CASE
      WHEN timer OR new_action = 'tick' AND status IS NOT NULL THEN CASE WHEN status = 'processing' AND lease <= now THEN CASE WHEN att >= 5 THEN 'lost' ELSE 'abandoned' END
        WHEN status IN {_LIVE} AND (dat IS NULL OR dat + 1800 + 60 <= now) THEN CASE WHEN att >= 5 OR disp >= 5 THEN 'never' WHEN status = 'queued' AND dat IS NOT NULL THEN 'expired' ELSE 'dispatched' END WHEN status IN {_LIVE} AND resume <= now THEN 'resumed' ELSE 'idle' END
      WHEN new_action = 'claim' THEN CASE WHEN status IS NULL OR reclaim AND status IN ('skipped_closed', 'superseded') THEN 'queued' ELSE 'duplicate_skipped' END
      WHEN status IS NULL THEN 'unknown'
      WHEN new_action = 'acquire' THEN CASE WHEN (status IN {_LIVE} OR status = 'processing' AND (lease <= now OR redel AND task = new_task)) AND att < 5 THEN 'acquired' ELSE 'refused' END
      WHEN new_action = 'unpublished' THEN CASE WHEN status = 'queued' AND owner IS NULL THEN 'unpublished' ELSE 'refused' END
      WHEN new_action = 'requeue' THEN CASE WHEN status = 'failed' THEN 'requeued' ELSE 'refused' END
      WHEN status <> 'processing' OR new_action NOT IN ('close', 'supersede') AND owner IS DISTINCT FROM worker THEN 'fenced'
      WHEN new_action = 'assert' THEN CASE WHEN lease > now THEN 'held' ELSE 'fenced' END
      WHEN new_action = 'defer' THEN CASE WHEN defs < 3 AND now - coalesce(since, now) + wait <= 3600 AND att < 5 THEN 'deferred' ELSE 'spent' END
      ELSE map {{'checkpoint': 'saved', 'finish': 'finished', 'retry': 'retried', 'fail': 'failed', 'close': 'closed', 'supersede': 'superseded'}}[new_action] END AS does
    FROM (SELECT r.*, e.seq AS new_seq, e.action AS new_action, e.task AS new_task, e.worker, e.value AS new_value, e.reclaim, e.redel, greatest(coalesce(try_cast(e.value AS DOUBLE), 0), 0) AS wait,
        coalesce(r.wakes <= coalesce(e.m, {until or 'NULL'}), false) AS timer, CASE WHEN coalesce(r.wakes <= coalesce(e.m, {until or 'NULL'}), false) THEN r.wakes ELSE e.m END AS now
      FROM (SELECT * EXCLUDE (seq, m, action, does, value), {wake} AS wakes FROM run) r LEFT JOIN numbered e ON e.key = r.key AND e.i = r.i + 1)
    WHERE timer OR new_seq IS NOT NULL)
), outcomes AS (SELECT key AS claim_key, seq, m AS "at", action, CASE WHEN does IN ('lost', 'never', 'spent') THEN 'failed' WHEN does = 'expired' THEN 'dispatched' WHEN does IN ('unpublished', 'retried', 'closed', 'superseded') THEN 'released' ELSE does END AS result, status, att AS attempts,
  CASE does WHEN 'failed' THEN coalesce(left(value, 2000), '') WHEN 'lost' THEN '{claims.LEASE_LOST}' WHEN 'never' THEN '{claims.NEVER_TAKEN}' WHEN 'spent' THEN '{claims.BUDGET_SPENT.replace("'", "''")}' END AS dead_letter FROM run WHERE does <> 'start')"""


_ACTIONS = ("claim", "acquire", "checkpoint", "tick", "finish", "retry", "fail", "close", "assert", "tick")
_PLAIN = f"{t.EVENTS}, raw_events AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS m, list_extract({list(_ACTIONS)}, k % 10 + 1) AS action, event_type AS task, 'w' AS worker, 'completed_no_findings' AS value, k % 2 = 0 AS reclaim, false AS redel FROM ev)"


def _claim_events(spark: SparkSession, d: str) -> DataFrame:
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("k") % 10 + 1).cast("int"))
    return t.events(spark, d).select(
        F.col("user_id").alias("claim_key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), action.alias("action"), F.col("event_type").alias("task_id"), F.lit("w").alias("worker"), F.lit("completed_no_findings").alias("value"), (F.col("k") % 2 == 0).alias("allow_reclaim"), F.lit(False).alias("redelivered"),
    )


@query("st2_st8_lease_transitions", f"WITH RECURSIVE {claim_sql(_PLAIN)} SELECT * FROM outcomes")
def st2(spark, d):
    return claims.replayed(_claim_events(spark, d), "claim_key")


@query("st5_st7_dead_letters", f"WITH RECURSIVE {claim_sql(_PLAIN)} SELECT * EXCLUDE (dead_letter), dead_letter AS error FROM outcomes WHERE dead_letter IS NOT NULL")
def st5(spark, d):
    return claims.dead_letter_rows(claims.replayed(_claim_events(spark, d), "claim_key"))


# A worker's day on each claim, its hours a hundred and twentieth of the events': enough for leases, messages and deferrals to run out.
_TIMED = ("claim", "acquire", "checkpoint", "acquire", "defer", "acquire", "finish", "acquire", "retry", "acquire", "fail", "close", "unpublished", "requeue", "acquire", "supersede", "assert", "claim", "acquire", "tick")
_LAG_MS = 600_000
_UNTIL = f"(SELECT (max(epoch_us(ts) // 120) // 1000 - {_LAG_MS}) / 1000 FROM events)"
_TIMED_SQL = f"{t.EVENTS}, raw_events AS (SELECT user_id AS key, event_id AS seq, (epoch_us(ts) // 120) / 1e6 AS m, list_extract({list(_TIMED)}, k % 20 + 1) AS action, CASE k % 3 WHEN 0 THEN 'a' ELSE 'b' END AS task, CASE WHEN k % 7 = 0 THEN 'x' ELSE 'w' END AS worker, (k * 17)::VARCHAR AS value, k % 4 < 2 AS reclaim, k % 5 = 0 AS redel FROM ev)"


def timed_events(events: DataFrame) -> DataFrame:
    micros = F.expr("unix_micros(cast(ts as timestamp)) div 120")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("claim_key"), F.col("event_id").alias("seq"), (micros / 1e6).alias("at"), F.element_at(F.array(*map(F.lit, _TIMED)), (k % 20 + 1).cast("int")).alias("action"), F.when(k % 3 == 0, "a").otherwise("b").alias("task_id"),
        F.when(k % 7 == 0, "x").otherwise("w").alias("worker"), (k * 17).cast("string").alias("value"), (k % 4 < 2).alias("allow_reclaim"), (k % 5 == 0).alias("redelivered"), F.timestamp_micros(micros).alias("ts"),
    )


@query("st11_st15_timed_claims", f"WITH RECURSIVE {claim_sql(_TIMED_SQL, _UNTIL)} SELECT * FROM outcomes")
def timed(spark, d):
    """Claims with all their timers, over a table."""
    e = timed_events(t.table(spark, d, "events"))
    until = ((e.agg(F.max(F.unix_millis("ts"))).first()[0] or 0) - _LAG_MS) / 1000
    return claims.replayed(e.where(F.col("at") <= until), "claim_key", until)


@query("st2_st15_claim_stream", f"WITH RECURSIVE {claim_sql(_TIMED_SQL, _UNTIL)} SELECT * FROM outcomes")
def stream(spark, d):
    """The same events as a stream, up to its watermark, ten minutes behind the last one."""
    return running.drained(claims.claim_stream(timed_events(t.streamed(spark, d, "events")), "claim_key", f"{_LAG_MS} milliseconds"), "claims")


# ---- the first of all ----


@query("st1_idempotent_claim", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'queued' ELSE 'duplicate_skipped' END AS result FROM events")
def st1(spark, d):
    """Every event claims its review; the state machine tells which came first."""
    key = F.concat_ws("/", "user_id", "event_type")
    e = t.table(spark, d, "events").select(key.alias("claim_key"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit("claim").alias("action"), F.col("event_type").alias("task_id"), F.lit("w").alias("worker"), F.lit("").alias("value"), F.lit(False).alias("allow_reclaim"), F.lit(False).alias("redelivered"))
    return claims.replayed(e, "claim_key").select(F.col("seq").alias("event_id"), "result")


@query("st9_current_stream", "WITH w AS (SELECT ((epoch_us(max(ts)) // 1000) - 600000) * 1000 AS w FROM events) SELECT event_id FROM events e WHERE epoch_us(ts) + 43200000000 <= (SELECT w FROM w) AND NOT EXISTS (SELECT 1 FROM events h WHERE h.user_id = e.user_id AND h.event_type <> e.event_type AND h.ts > e.ts AND h.ts <= e.ts + INTERVAL 12 HOUR)")
def st9(spark, d):
    """Events that no event of another kind by the same user follows within twelve hours, up to the watermark."""
    e = t.streamed(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    sink = heads.StillCurrent(running.shared_folder(spark, "current"), ("user_id",), "event_type", "ts", timedelta(hours=12), timedelta(minutes=10))
    running.drained(e, "heads", sink)
    return sink.rows(spark, e.schema).select("event_id")
