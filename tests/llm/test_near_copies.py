"""The pipeline's near-duplicate stage against brute force over 5-word shingles of whole texts."""

import random

import pytest

import corpus_pipeline
from sparkloom.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))


def edited(rng, text, low, high):
    """A copy with words replaced until its similarity is in [low, high)."""
    while True:
        words = text.split()
        for _ in range(rng.randrange(1, max(3, len(words) // 10))):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        if low <= jaccard(text, " ".join(words)) < high:
            return " ".join(words)


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 7, "member_rows": 2, "broadcast_bytes": -1}])
def test_edited_copies(spark, options):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(120, 500))) for _ in range(60)]
    texts, near, apart = list(base), [], []
    for k, t in enumerate(base):
        low = 0.80 + 0.05 * (k % 3)
        near.append((k, len(texts)))
        texts.append(edited(rng, t, low, low + 0.05))
        if k % 3 == 0:
            apart.append(len(texts))
            texts.append(edited(rng, t, 0.60, 0.66))
    texts += [base[0], None, " ", "three words here", "Three  words here"]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)
    parent = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if (not shingles(a or "") and not shingles(texts[j] or "")) or jaccard(a or "", texts[j] or "") >= 0.8:
                x, y = parent[i], parent[j]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    got = {r.doc_id: r for r in near_copies.near_copies(df, **options).collect()}
    assert [got[i].component for i in range(len(texts))] == parent
    assert all(got[i].kept == (parent[i] == i) for i in range(len(texts)))
    if not options:
        kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()}
        assert not {j for _, j in near} & kept and set(apart) <= kept


def test_odd_tables(spark):
    assert near_copies.near_copies(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (None, "A B c d e f")], "doc_id long, text string")
    got = near_copies.near_copies(odd).collect()
    assert sorted((r.doc_id or 0, r.component or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1)]
