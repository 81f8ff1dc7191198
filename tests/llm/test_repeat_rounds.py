"""Rounds of ranking: batch borders change nothing, hot keys are split and lose nothing, counts of keys hold hot ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import repeats

NAMES = ["key", "salt", "whole", "weight", "crowded", "id"]


def by_force(rows):
    done, more = set(), set()
    for key in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == key]
        crowded = any(r[4] for r in mine) or len({r[2] for r in mine}) > 1
        for whole in {r[2] for r in mine}:
            run = [r for r in mine if r[2] == whole]
            times = sum(r[3] for r in run)
            done |= {(r[5], "other") for r in run[1:]}
            done |= {(run[0][5], "first", times > 1, crowded)}
    return done | more


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_batches_cut_anywhere(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(4), rng.randrange(2), rng.randrange(3), rng.choice([1, 1, 2]), rng.random() < 0.05, i) for i in range(60))
    rows += [(9, 0, 0, 1, False, 100 + i) for i in range(3 * size)] + [(9, 0, 1, 1, False, 999)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + size]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.bool_(), pa.int64()))], names=NAMES) for a in range(0, len(rows), size)]
    got = set()
    for table, firsts, times, mixed, others in repeats.ranked_rows(batches):
        assert table.num_rows <= size + 1
        ids = table.column("id").to_pylist()
        got |= {(ids[i], "other") for i in others} | {(ids[i], "first", bool(t > 1), bool(m)) for i, t, m in zip(firsts, times, mixed)}
    # A key that shows to be mixed only in a later batch is mixed for its first run, too, as that run waits.
    assert got == by_force(rows)


def test_counts_hold_every_frequent_key():
    rng = np.random.default_rng(3)
    common = bytes(rng.integers(97, 123, 120).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 150).astype(np.uint8)) + common + bytes(rng.integers(97, 123, 150).astype(np.uint8)) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([t.decode() for t in texts[a : a + 50]])], names=["row_key", "text"]) for a in range(0, 200, 50)]
    found = {k: n for b in repeats._frequent(200, counters=16)(iter(batches)) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    total = found.pop(None)
    assert len(found) <= 16 and max(found.values()) >= 200 - total / 16


def test_a_hot_line_with_different_neighbours(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = some(150), some(300)
    texts = [some(120) + line + some(120) for _ in range(150)] + [some(50) + passage[:260] + some(60), some(90) + passage[20:] + some(70)]
    texts += [texts[3], texts[5][:200], some(10) + texts[7][30:290]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    seen: dict[str, set] = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - 199):
            seen.setdefault(t[s : s + 200], set()).add((i, s))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i] |= set(range(s, s + 200))
    want = ["".join(c for k, c in enumerate(t) if k not in g) for t, g in zip(texts, gone)]
    for group_rows, hot_keys in ((4096, 4096), (8, 64)):
        got = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats(df, group_rows=group_rows, hot_keys=hot_keys).collect()}
        assert [got[i] for i in range(len(texts))] == want
