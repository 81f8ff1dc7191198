"""Work held until no newer head can make it obsolete: in batches, against a loop over all pairs, and as a stream without a join's state."""

import datetime
import os
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sparkloom.plans import claim_queries
from sparkloom.streaming import heads, running

SCHEMA = "id long, repo string, pull long, sha string, ts timestamp, is_work boolean, is_head boolean"
HOLD, DELAY = datetime.timedelta(seconds=60), datetime.timedelta(seconds=20)


def at(seconds):
    return datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(seconds=seconds)


def some_batches(seed, sizes, both, clean=False):
    """Times rise from before 1970 by quarters of a second, many of them equal; some come late, and some values are null."""
    rng, now, n, batches = random.Random(seed), -400.0, 0, []
    for size in sizes:
        rows = []
        for _ in range(size):
            now += rng.choice([0, 0, 0.25, 3])
            late = rng.choice([0, 0, 0, 5, 19] if clean else [0, 0, 0, 5, 19, 90, 300])
            kind = (True, True) if both else rng.choice([(True, True), (True, False), (False, True), (False, False), (None, True), (True, None)])
            null = not clean and rng.random() < 0.1 and rng.randrange(3)
            rows.append((n, None if null == 0 and null is not False else rng.choice("ab"), rng.randrange(2), None if null == 1 else rng.choice("xxxy"), None if null == 2 else at(now - late), *kind))
            n += 1
        batches.append(rows)
    return batches


def expected(batches):
    taken, passed, out, gone = [], None, [], set()
    for rows in batches:
        taken += [r for r in rows if r[4] is not None and (r[5] or r[6]) and (passed is None or r[4] > passed)]
        newest = [[r[4] for r in taken if r[side]] for side in (5, 6)]
        if all(newest):
            low = min(map(max, newest))
            passed = low - datetime.timedelta(microseconds=low.microsecond % 1000) - DELAY
        for r in taken:
            if passed is not None and r[5] and r[0] not in gone and r[4] + HOLD <= passed:
                gone.add(r[0])
                met = None not in r[1:4] and any(h[6] and h[1:3] == r[1:3] and h[3] not in (None, r[3]) and r[4] < h[4] <= r[4] + HOLD for h in taken)
                if not met:
                    out.append(r[0])
    return sorted(out)


def sink_at(folder, **more):
    return heads.StillCurrent(str(folder), ("repo", "pull"), "sha", "ts", HOLD, DELAY, **more)


def ids(spark, sink, schema):
    return sorted(r.id for r in sink.rows(spark, schema).collect())


@pytest.mark.parametrize("seed, both, spans", [(1, True, 1), (2, False, 2), (3, False, 8)])
def test_batches_against_pairs(spark, tmp_path, seed, both, spans):
    batches = some_batches(seed, (150, 1, 150, 150), both)
    sink = sink_at(tmp_path / "current", spans=spans, **({} if both else {"work": "is_work", "head": "is_head"}))
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA)
        sink(batch, n)
        assert ids(spark, sink, batch.schema) == expected(batches[: n + 1])
    assert expected(batches)
    sink(batch, n)  # again, as after a crash
    assert ids(spark, sink, batch.schema) == expected(batches)


def test_no_batch_and_an_empty_one(spark, tmp_path):
    sink, none = sink_at(tmp_path / "current"), spark.createDataFrame([], SCHEMA)
    assert ids(spark, sink, none.schema) == []
    sink(none, 0)
    sink(none, 1)
    assert ids(spark, sink, none.schema) == []


def test_work_waits_for_the_first_head(spark, tmp_path):
    sink = sink_at(tmp_path / "current", work="is_work", head="is_head")
    batches = [[(i, "a", 1, "x", at(50 * i), True, False) for i in range(4)], [(9, "a", 1, "y", at(110), False, True), (10, "a", 1, "x", at(300), False, True)]]
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, SCHEMA)
        sink(batch, n)
        assert ids(spark, sink, batch.schema) == expected(batches[: n + 1]) == [[], [0]][n]


def test_own_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="held"):
        sink_at(tmp_path / "current")(spark.createDataFrame([], SCHEMA + ", held long"), 0)


def test_what_is_held_is_bounded(spark, tmp_path):
    """Each batch holds back the last eighty seconds' rows alone, and older ones' are gone from the disk."""
    sink = sink_at(tmp_path / "current")
    for n in range(4):
        sink(spark.createDataFrame([(i, "a", 1, "x", at(i), True, True) for i in range(n * 300, n * 300 + 300)], SCHEMA), n)
    held = [p.name for p in (tmp_path / "current").iterdir() if (p / "held=true").exists()]
    assert sorted(held) == ["batch=2", "batch=3"]
    assert spark.read.parquet(str(tmp_path / "current/batch=3/held=true")).count() == 80


def test_one_key_at_once(spark, tmp_path):
    """40,000 rows of one key within a hold would be 800 million pairs."""
    rows = spark.range(40_000).select("id", F.lit("a").alias("repo"), F.lit(1).cast("long").alias("pull"), F.lit("x").alias("sha"), F.timestamp_micros(F.col("id")).alias("ts"))
    last = spark.createDataFrame([(40_000, "a", 1, "y", at(HOLD.total_seconds() + 0.01)), (40_001, "b", 1, "x", at(200))], rows.schema)
    sink = sink_at(tmp_path / "current")
    sink(rows.unionByName(last), 0)
    assert ids(spark, sink, rows.schema) == [*range(10_000), 40_000]


def test_join_and_sink_agree(spark, tmp_path):
    batches = some_batches(4, (120, 120, 120), True, clean=True)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = sink_at(tmp_path / "current")
    running.drained(stream, "heads", sink)
    joined = running.drained(heads.still_current(stream, stream.select("repo", "pull", "sha", "ts"), ["repo", "pull"], "sha", "ts", "60 seconds", "20 seconds"), "joined")
    assert ids(spark, sink, joined.schema) == sorted(r.id for r in joined.collect()) == expected(batches)


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="the driver's tables are not here")
def test_query_keeps_no_table_in_state_stores(spark, tmp_path, monkeypatch):
    """The whole table is one batch: a join would put all its rows into four stores a partition."""
    monkeypatch.setattr(running, "shared_folder", lambda spark, tag: str(tmp_path / tag))
    assert claim_queries.st9(spark, f"{DATA}/sf0.001").count()
    assert (tmp_path / "heads/checkpoint").is_dir() and not list(tmp_path.rglob("state"))
