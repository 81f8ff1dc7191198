"""Tiles of population counts: pairs across bands, huge buckets by finer masks, and no pair that cannot link."""

import random

import numpy as np
import pytest
from test_llm_operators import roots

from sparkloom.llm import components, simhash


@pytest.mark.parametrize("keep, bucket, most_parts", [(1, 4096, None), (1, 4, 1), (1, 3, 2), (2, 2, 1)])
def test_tiles_lose_no_link(spark, keep, bucket, most_parts):
    rng = random.Random(keep * 100 + bucket)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(9))) for _ in range(60)}
    fps = list(near | {0, (1 << 64) - 1, 0xF, 0x1F, 0xFF, 0x1FF} | {rng.getrandbits(64) for _ in range(40)})
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    edges = simhash.near_fingerprints(spark.createDataFrame(rows, "fp long, node long"), 4, keep, bucket, most_parts)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])


def test_upper_band_does_not_meet_itself():
    fp = np.array([0b1, 0b11111, 0b111111, 0b11111 << 40], np.uint64)  # counts 1, 5, 6, 5: bands 0, 1, 1, 1
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    parent = simhash.tile_links(fp[order], 4, lows=1)
    assert parent.tolist() == [0, 0, 2, 3]
    assert simhash.tile_links(fp[order], 4).tolist() == [0, 0, 2, 0]


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [b" ".join(rng.choice([b"a", b"Bc", b"def", b"\xc3\xa9g"]) + b"\n" * rng.randrange(3) for _ in range(n)) for n in (0, 1, 3, 4, 5, 50, 400)] + [b"x" * 300 + b" " + b"y" * 200, b" " * 200 + b"a b", b"a b" + b"\t" * 150 + b"c d e"]
    whole = simhash.fingerprints_of(texts, len(texts)).tolist()
    shingles = [list(simhash.in_pieces([t], 4)) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 40)
    cut = [list(simhash.in_pieces([t], 4, 100)) for t in texts]
    for a, b in zip(shingles, cut):
        join = lambda x: sorted(np.concatenate([h for h, _ in x]).tolist()) if x else []
        assert join(a) == join(b)
    assert simhash.fingerprints_of(texts, len(texts)).tolist() == whole
