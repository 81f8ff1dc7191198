"""Claims as keyed state with timers: against a clock that looks every second, and over a stream in pieces with restarts."""

import datetime
import math
import random
import time

from pyspark.sql import functions as F

from sparkloom.streaming import claims, running

SCHEMA = "claim_key long, seq long, at double, action string, task_id string, worker string, value string, allow_reclaim boolean, redelivered boolean, ts timestamp"
ACTIONS = ["claim", "acquire", "acquire", "checkpoint", "assert", "finish", "retry", "fail", "close", "supersede", "defer", "defer", "unpublished", "requeue", "tick"]
BASE = 1_700_000_000


def some_events(n, keys, seed, gap=500):
    rng, at, rows = random.Random(seed), float(BASE), []
    for i in range(n):
        at += rng.randrange(gap)
        rows.append((rng.randrange(keys), i, at, rng.choice(ACTIONS), rng.choice("ab"), rng.choice("wwx"), rng.choice(["90", "700", "oops", None]), rng.random() < 0.5, rng.random() < 0.3, datetime.datetime.fromtimestamp(at)))
    return rows


def by_the_second(rows, until, keep):
    """Each second every claim is repaired until nothing is left to do, then the events of that second are taken."""
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key and r[2] <= until), key=lambda r: (r[2], r[1]))
        state, rested = None, None
        for second in range(int(mine[0][2]) if mine else 0, int(until) + 1 if mine else 0):
            now = float(second)

            def repair():
                nonlocal state
                while state is not None:
                    changed, result, dead = claims.reconciled(state, now)
                    if result == "idle":
                        break
                    state = changed
                    out.append((key, None, now, "timer", result, state["status"], state["attempts"], dead))

            repair()
            if state is not None and state["status"] not in ("processing", *claims.CLAIMABLE):
                rested = rested if rested is not None else now
                if now - max(rested, last) >= keep:
                    state = None
                    out.append((key, None, now, "timer", "forgotten", None, None, None))
            else:
                rested = None
            while mine and mine[0][2] == now:
                repair()
                r = mine.pop(0)
                e = dict(zip(["claim_key", "seq", *claims.EVENT], r))
                state, result, dead = claims.step(state, e)
                last = now
                out.append((key, r[1], now, r[3], result, state and state["status"], state and state["attempts"], dead))
            repair()
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[2], r[1] is not None, r[1] or 0, r[4]))


def test_timers_against_a_clock(spark):
    rows = some_events(500, 3, 11, 250)
    until, keep = rows[-1][2] + 9_000, 4_000.0
    table = spark.createDataFrame(rows, SCHEMA).drop("ts").repartition(5)
    got = order(claims.replayed(table, "claim_key", until, keep).collect())
    want = order(by_the_second(rows, until, keep))
    assert got == want
    results = {r[4] for r in got if r[3] == "timer"}
    assert {"abandoned", "dispatched", "resumed", "forgotten"} <= results and any(r[7] for r in got if r[3] == "timer")


def test_chain_of_deferrals_ends_in_a_dead_letter():
    e = lambda action, at, **more: dict.fromkeys(claims.EVENT) | {"action": action, "at": at, "worker": "w", "task_id": "t"} | more
    state, at, out = None, 0.0, []
    events = [e("claim", 0.0)]
    for n in range(4):
        events += [e("acquire", 100.0 * n + 1), e("defer", 100.0 * n + 2, value="20.2")]
    for state, row in claims.timed(None, events, 10_000.0):
        out.append(row[1:4])
    assert out[1:5] == [(1.0, "acquire", "acquired"), (2.0, "defer", "deferred"), (23.0, "timer", "resumed"), (101.0, "acquire", "acquired")]
    assert out[-1] == (302.0, "defer", "failed") and state["error"] == claims.BUDGET_SPENT and state["deferrals"] == 3


def test_stream_in_pieces_equals_the_table(spark, tmp_path):
    """Files arrive out of order within the watermark, and the query stops and starts again between them."""
    rows = some_events(240, 7, 23)
    lag = 3_000
    files = [[] for _ in range(6)]
    for i, r in enumerate(rows):
        files[min(5, max(0, i // 40 + (-1 if i % 5 == 0 and i % 40 < 5 else 0)))].append(r)
    stream = lambda: claims.claim_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "claim_key", f"{lag} seconds", keep=20_000)
    for k in range(0, 6, 2):
        for part in files[k : k + 2]:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with running.rocksdb(spark):
            q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(200)
            assert q.exception() is None
    until = math.floor(rows[-1][2] * 1000 - lag * 1000) / 1000
    table = spark.createDataFrame([r for r in rows if r[2] <= until], SCHEMA).drop("ts")
    want = claims.replayed(table, "claim_key", until, 20_000)
    assert order(spark.read.parquet(str(tmp_path / "out")).collect()) == order(want.collect())


def test_processing_time_goes_by_the_clock(spark, tmp_path):
    """A lease that ran out long ago is abandoned as soon as the clock is asked."""
    at = time.time() - 1500
    rows = [(1, n, at + n, action, "t", "w", None, False, False, None) for n, action in enumerate(("claim", "acquire"))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = claims.claim_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "claim_key", None)
    with running.rocksdb(spark):
        q = stream.writeStream.format("memory").queryName("claims_by_clock").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    until, got = time.time() + 60, []
    while time.time() < until and len(got) < 3:
        time.sleep(1)
        got = [(r.action, r.result) for r in spark.table("claims_by_clock").orderBy("at").collect()]
    q.stop()
    assert got[:3] == [("claim", "queued"), ("acquire", "acquired"), ("timer", "abandoned")]


def test_provider_setting_is_put_back(spark):
    before = spark.conf.get(running.PROVIDER, None)
    with running.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(running.PROVIDER)
    assert spark.conf.get(running.PROVIDER, None) == before
    assert spark.range(1).select(F.lit(running.shared_folder(spark, "x"))).count() == 1
