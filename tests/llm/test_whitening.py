"""Whitening against plain numpy with Python integers."""

import math

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from sparkloom.llm import queries, whitening

ROWS = "vec_id long, embedding array<float>"


def by_force(rows, components=16):
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted(set(tuple(x) for _, x in kept)), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums).astype(float)) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    white = {i: (int(((n * np.array(x, dtype=object) - sums) ** 2).sum()), ((n * np.array(x, dtype=object) - sums).astype(float) / n) @ u / np.sqrt(e)) for i, x in kept}
    return n, white, e / np.trace(cov)


def check(got, rows, components=16):
    n, white, explained = by_force(rows, components)
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert table.keys() == white.keys() and len(got) == components * len(white)
    sign = {}
    for i, (deviation, w) in white.items():
        for k in range(components):
            r = table[i][k + 1]
            assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9
            if abs(w[k]) > 1e-3:
                sign.setdefault(k, np.sign(w[k] * r.whitened))
            assert abs(r.whitened * sign.get(k, 1) - w[k]) < 1e-6


def test_whole_table(spark):
    vectors = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    got = queries.op13_embedding_whitening(spark, f"{DATA}/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(got.collect(), [(r.vec_id, r.embedding) for r in vectors.collect()])


def test_odd_rows_and_any_partitioning(spark):
    rng = np.random.default_rng(3)
    base = [[float(v) for v in rng.normal(size=5)] for _ in range(40)]
    rows = list(enumerate(base + [base[0]] * 30 + [[0.0] * 5]))
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows + odd], "vec_id long, embedding array<double>").withColumns({c: F.lit("z") for c in ("id", "x", "component", "n", "dim", "total", "label")})
    for parts in (1, 7):
        check(whitening.whiten(df.repartition(parts), components=4).collect(), rows, 4)


def test_ties_of_rank_and_few_vectors(spark):
    flat = spark.createDataFrame([(i, [float(i % 3), 0.0, float(i % 3)]) for i in range(9)], ROWS)
    got = whitening.whiten(flat).collect()
    assert {(r.component, r.n) for r in got} == {(1, 3)} and len(got) == 9 and all(abs(r.explained - 1) < 1e-12 for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], ROWS)
    assert whitening.whiten(one).count() == 0
    empty = whitening.whiten(spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and empty.columns == got[0].__fields__
    ids = spark.createDataFrame([(None, [0.0, 1.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0])], ROWS)
    assert sorted((r.vec_id is None, r.deviation) for r in whitening.whiten(ids).collect()) == [(False, 8192), (True, 8192), (True, 8192)]


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e14, 0.0]), (2, [-1e14, 1.0]), (3, [5.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert dict(got.dtypes)["deviation"] == "decimal(38,0)"
    _, white, _ = by_force(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in got.where("component = 1").collect()} == {i: d for i, (d, _) in white.items()}
