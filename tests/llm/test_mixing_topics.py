"""Topics are fitted over all documents, not over those the fit starts from."""

import random

import numpy as np
import pytest

from sparkloom.llm import mixing


def test_topics_settle_over_all_rows(spark):
    rng = random.Random(1)
    texts = [" ".join(f"topic{i % 3}word{rng.randrange(40)}" for _ in range(60)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bags = mixing.with_bags(df, ["doc_id"]).cache()
    # The few rows it starts from may miss a topic, and cannot give the mean of a hundred documents.
    c = mixing.fit_topics(bags, "doc_id", topics=3, start_rows=6)
    rows = {r.doc_id: r.topic for r in mixing.with_topics(bags, c, ["doc_id"]).collect()}
    x = mixing._units(bags.orderBy("doc_id").select("bag").toArrow().column("bag"), 512)
    for k in range(3):
        mean = x[[i for i in range(300) if rows[i] == f"t{k}"]].sum(axis=0)
        assert c[k] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-3)
    assert len(set(rows.values())) == 3


def test_partitions_and_batches_change_nothing(spark):
    rng = random.Random(2)
    texts = [" ".join(f"topic{i % 4}word{rng.randrange(30)}" for _ in range(rng.randrange(1, 90))) for i in range(400)] + ["the same words"] * 150
    df = spark.createDataFrame([(i, t, "abc"[i % 3], "xy"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    runs = []
    for n, batch in ((1, "10000"), (7, "13"), (3, "97")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        rows = mixing.mix_documents(df.orderBy(df.doc_id * 7919 % 1000).repartition(n)).collect()
        runs.append({r.doc_id: (r.topic, r.weight, r.copies) for r in rows})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(runs[0]) == 550 and runs[0] == runs[1] == runs[2]


def test_worst_vectors_are_different_ones(spark):
    # Copies of one vector fit no cell: only one of them may fill an empty cell.
    c = np.zeros((3, 8))
    c[[0, 1, 2], [0, 1, 2]] = 1
    bags = [np.eye(8, dtype=np.uint32)[i].tobytes() for i in (0, 5, 5, 5, 6, 1)]
    batch = mixing.pa.RecordBatch.from_arrays([mixing.pa.array(bags, mixing.pa.binary())], names=["bag"])
    out = [r for b in mixing._cell_sums(c)([batch]) for r in b.to_pylist()]
    worst = [np.frombuffer(r["total"], np.int64).argmax() for r in out if r["topic"] < 0]
    assert len(worst) == 3 and set(worst) >= {5, 6}
    assert sorted((r["topic"], r["n"]) for r in out if r["topic"] >= 0) == [(0, 5), (1, 1)]
