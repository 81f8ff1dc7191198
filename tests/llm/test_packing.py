"""Packing: the plan against all subsets, and every piece against the library's ids."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


def check(pieces, rows, capacity=2048):
    """Each document's ids lie in its pieces once, in order, and each sequence is gapless, within the capacity and unpadded."""
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append(ids)
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == want.keys()
    for i, copies in want.items():
        same = len({c.tobytes() for c in copies}) == 1
        assert sum(p.length for p in got[i]) == sum(map(len, copies))
        if same:
            ids = copies[0]
            cover = np.zeros(len(ids), int)
            for p in got[i]:
                assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
                cover[p.start : p.start + p.length] += 1
            assert (cover == len(copies)).all()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    short = []
    for spans in sequences.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and spans[0][0] == 0
        size = sum(n for _, n in spans)
        assert size <= capacity and size & (size - 1) == 0
        short += [size] * (size < capacity)
    assert len(short) == len(set(short))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    check(queries.op12_packing(spark, f"{DATA}/sf0.001").collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("capacity", [64, 256])
def test_odd_rows(spark, capacity):
    rng = random.Random(4)
    words = ["alpha", "beta,", "<|endoftext|>", "x\ny", "ünï", " ", "  ", "\n\n", "9", ""]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(120)))) for i in range(60)]
    rows += [(None, None), (None, None), (70, None), (71, ""), (72, " "), (73, "a "), (74, "same text"), (74, "same text"), (75, "z" * 5000), (76, "a  \n b"), (77, "q " * 3000), (78, "long text\n of words " * 40_000)] + [(100 + i, "one copy of many") for i in range(80)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("k") for c in ("id", "row_key", "part", "length", "crc", "n")}).repartition(5)
    check(packing.pack_documents(df, PATH, capacity=capacity).collect(), rows, capacity)


def test_empty(spark):
    got = packing.pack_documents(spark.createDataFrame([], DOCS), PATH)
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_closest_fill_by_force():
    rng = random.Random(8)
    for _ in range(200):
        left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        target = rng.randrange(1, 60)
        best = max(s for s in (sum(k * n for k, n in zip(left, c)) for c in itertools.product(*(range(v + 1) for v in left.values()))) if s <= target)
        found = packing.closest_fill(left, target)
        assert sum(k * v for k, v in found.items()) == best and all(v <= left[k] for k, v in found.items())


@pytest.mark.parametrize("counts", [{1500: 7}, {1: 5000}, {2047: 10**9}, {3: 1, 700: 10**12, 701: 3}, {k: 10**6 + k * k % 977 for k in range(1, 2048)}, {k: 1 for k in range(1, 2048)}, {}])
def test_plan_stays_small_and_exact(counts):
    plan, sequences = packing.plan_windows(counts, 2048)
    tokens = sum(k * v for k, v in counts.items())
    assert len(plan) < 60_000 and sequences == tokens // 2048 + bin(tokens % 2048).count("1")
