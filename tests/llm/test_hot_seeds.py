"""Decontamination against brute force over all pairs, with phrases common to many documents and items."""

import random

import numpy as np
import pytest

from sparkloom.llm import decontaminate as d


def by_force(texts, items, similarity=0.8, least=12):
    tokens, found = d.Tokens(), {}
    for i, text in enumerate(texts):
        a = tokens(text or "")
        for k, item in enumerate(items):
            b = tokens(item or "")
            if len(b) < 5:
                continue
            need, best = min(len(b), least), 0
            for shift in range(-len(b) + 1, len(a)):
                n, m, _, _ = d.best_overlap(a, b, shift, similarity)
                if n >= need or n and len(b) <= least and m >= similarity * len(b):
                    best = max(best, n)
            if best:
                found[i, k] = best
    return found


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    common = ["what", "is", "the", "name", "of"]
    items = [some(rng.randrange(0, 6)) + common + some(rng.randrange(0, 30)) for _ in range(40)] + [some(7), some(4), some(12), common]
    texts = [some(rng.randrange(0, 20)) + common + some(rng.randrange(0, 20)) for _ in range(40)]
    for _ in range(60):
        item = list(rng.choice(items))
        a = rng.randrange(max(1, len(item) - 14))
        part = item[a : a + rng.randrange(10, 40)]
        for j in rng.sample(range(len(part)), int(len(part) * rng.choice([0.0, 0.1, 0.2, 0.3]))):
            part[j] = "other"
        texts.append(some(rng.randrange(15)) + part + some(rng.randrange(15)))
    texts.append(some(500) + items[0] + some(3000))
    return [" ".join(t) for t in texts] + [None, ""], [" ".join(t) for t in items] + [None, ""]


@pytest.mark.parametrize("group_rows, broadcast", [(4096, 16 << 20), (8, -1), (3, 16 << 20)])
def test_contamination_by_force(spark, planted, group_rows, broadcast):
    texts, items = planted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = d.find_contamination(docs, bench, group_rows=group_rows, broadcast_bytes=broadcast).collect()
    assert {(r.doc_id, r.item_id): r.n_tokens for r in got} == by_force(texts, items) and len(got) > 40


def test_common_phrases_alone_leave_no_pairs(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    docs = spark.createDataFrame([(i, f"{some(20)} what is the name of {some(20)}") for i in range(100)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"what is the name of {some(20)}") for i in range(100)], "item_id long, text string")
    seen = []
    real = d.diagonals
    d.diagonals = lambda *a: seen.append(real(*a).count()) or real(*a)
    try:
        assert d.find_contamination(docs, bench).count() == 0
    finally:
        d.diagonals = real
    assert seen == [0]


def test_contexts():
    around = d.contexts(np.arange(10, 20, dtype=np.uint64), np.array([0, 9]), 4, 1)
    assert around.shape == (2, 9) and around[0].tolist() == [1, 1, 10, 11, 12, 13, 14, 15, 16] and around[1].tolist() == [17, 18, 19, 1, 1, 1, 1, 1, 1]


def test_seeds_of_many_documents_at_once():
    rng = np.random.default_rng(5)
    found = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 3, 4, 5, 1, 30)]
    doc = np.repeat(np.arange(len(found)), [len(t) for t in found])
    first = np.cumsum([0, *map(len, found)])
    for number, (place, h) in enumerate(d.seeds_of_many(np.concatenate(found), doc)):
        got = [(int(doc[p]), int(p - first[doc[p]]), int(h[p])) for p in place]
        assert got == [(i, k, int(x)) for i, t in enumerate(found) for k, x in enumerate(d.seeds(t, d.MASKS[number], number))]
