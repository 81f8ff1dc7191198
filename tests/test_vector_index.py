"""The stored vector index against exact search: recall, visited cells, hot cells, odd vectors, cut-offs."""

import os

import numpy as np
import pytest
from conftest import DATA

from sparkloom.operators import retrieval, vector_index
from sparkloom.plans import registry

ROWS = "id long, vector array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS)


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    return centres[rng.integers(0, 60, 6000)] + 0.3 * rng.standard_normal((6000, 32))


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="the driver's tables are not here")
def test_recall_on_the_given_vectors(spark):
    rows = registry.queries()["j1_index_recall"](spark, f"{DATA}/sf0.1").collect()
    assert len(rows) == 40 and sum(r.n_found for r in rows) >= 0.9 * sum(r.n_exact for r in rows)


def test_recall_and_visits_on_clusters(spark, clustered, tmp_path):
    corpus = frame(spark, clustered)
    path = str(tmp_path / "index")
    vector_index.build_index(corpus, path, cell_rows=50, trials=64)
    about = spark.read.parquet(f"{path}/about").first()
    assert about.n == 6000 and about.held >= 0.95 and about.probes < 0.4 * 2**about.bits
    assert spark.read.parquet(f"{path}/rows").count() == 6000
    asked = corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = pairs(retrieval.top_similar(asked, corpus, 20, exclude_self=True))
    found = vector_index.search_index(spark, path, asked, 20, exclude_self=True)
    assert len(exact & pairs(found)) >= 0.9 * len(exact)
    cut = vector_index.search_index(spark, path, asked, 20, exclude_self=True, block_bytes=16384)
    key = lambda df: sorted((r.query_id, r.id, r.nth, round(r.similarity, 9)) for r in df.collect())
    assert key(found) == key(cut)
    every = vector_index.search_index(spark, path, asked, 20, exclude_self=True, probes=1 << 20)
    assert pairs(every) == exact


def test_hot_cell_is_dealt_to_parts(spark, clustered, tmp_path):
    x = np.concatenate([clustered[:600], np.repeat(clustered[:1], 1200, axis=0)])
    corpus, path = frame(spark, x), str(tmp_path / "index")
    vector_index.build_index(corpus, path, cell_rows=100, part_rows=100, trials=16)
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.count() == 1800 and stored.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] < 200
    asked = corpus.where("id in (0, 5, 7)").withColumnRenamed("id", "query_id")
    whole, cut = (pairs(vector_index.search_index(spark, path, asked, 5, probes=1 << 20, block_bytes=b)) for b in (1 << 20, 300))
    assert whole == cut == pairs(retrieval.top_similar(asked, corpus, 5))


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.9, 0.1]), (7, [0.9, 0.1]), (8, [])]
    corpus, path = spark.createDataFrame(rows, ROWS), str(tmp_path / "index")
    vector_index.build_index(corpus, path)
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (10, None), (11, [1.0])], "query_id long, vector array<double>")
    got = [(r.query_id, r.id, r.nth) for r in vector_index.search_index(spark, path, asked, 3, 0.5, probes=2).orderBy("nth").collect()]
    assert got == [(9, 1, 1), (9, 7, 2), (9, 7, 3)]
    empty = str(tmp_path / "empty")
    vector_index.build_index(corpus.limit(0), empty)
    assert vector_index.search_index(spark, empty, asked, 3).collect() == []
    assert vector_index.search_index(spark, path, asked.limit(0), 3).collect() == []


def test_cut_off(spark, tmp_path):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [1.0, 0.1], 9), (3, [1.0, 0.0], None)], f"{ROWS}, at long")
    path = str(tmp_path / "index")
    vector_index.build_index(corpus, path)
    asked = spark.createDataFrame([(9, [1.0, 0.0], 9), (10, [1.0, 0.0], 10)], "query_id long, vector array<double>, before long")
    assert pairs(vector_index.search_index(spark, path, asked, 5)) == {(9, 1), (10, 1), (10, 2)}


def test_cells_by_force():
    far = np.array([0.5, -0.1, 0.3])
    cost = lambda c: sum(far[i] ** 2 for i in range(3) if (c >> i & 1) != (far[i] > 0))
    assert vector_index.cell_order(far).tolist() == sorted(range(8), key=cost)
