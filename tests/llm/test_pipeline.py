"""The corpus pipeline, stage by stage, on planted documents."""

import hashlib
import random

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import queries

SIZE = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SIZE}/documents.parquet")
    clean = [r for r in docs.where("n_chars > 600 and n_chars < 3000 and lang = 'en'").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{SIZE}/benchmark.parquet").first()
    text = clean[0].text
    rows = [(9001, None), (9002, "12 34 !!"), (9003, text + " more"), (9004, " ".join(rng.choice(clean).text.split()[:40]) + " " + item.text), (9005, clean[1].text[::-1] + ' token = "' + hashlib.sha1(b"x").hexdigest() + '" end'), (9006, "A word of its own that nobody else has written down.")]
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t) if t else None) for i, t in rows], docs.schema)
    return docs.unionByName(extra)


def test_stages(spark, planted):
    now, seen = planted, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, SIZE).cache()
        assert now.columns == corpus_pipeline.COLUMNS
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    first, second, third, fourth = seen.values()
    assert {9001, 9002} & first.keys() == set() and {9003, 9004, 9005, 9006} <= first.keys()
    assert 9003 not in second and {9004, 9005, 9006} <= second.keys()
    assert 9004 not in third and {9005, 9006} <= third.keys()
    assert fourth.keys() == third.keys() and "[SECRET]" in fourth[9005] and fourth[9006] == third[9006]
    last = corpus_pipeline.STAGES[4][1](spark, now, SIZE).collect()
    assert {r.doc_id for r in last} <= fourth.keys() and all(r.copies > 0 for r in last)


CLASH = ("row_key", "_row_key", "lang_pred", "score", "topic", "copies", "hash", "found", "id")


def test_empty_and_odd(spark, planted):
    """Repeated and null ids, null texts and languages, and columns whose names clash with those inside the stages."""
    odd = planted.unionByName(planted.where("doc_id = 9006")).unionByName(planted.where("doc_id = 9006").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(planted.where("doc_id = 9005").withColumn("doc_id", F.lit(9007).cast("long")).withColumn("text", F.concat("text", F.lit(" the and of that are for with this"))).withColumn("lang", F.lit(None).cast("string")))
    odd = odd.withColumns({c: F.lit("x") for c in CLASH})
    now, seen = odd, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd.limit(0), SIZE).count() == 0
        now = stage(spark, now, SIZE).cache()
        assert now.columns == odd.columns and now.select(*CLASH).distinct().collect() == [("x",) * len(CLASH)]
        seen.append(sorted((r.doc_id if r.doc_id is not None else -1, r.lang is not None) for r in now.select("doc_id", "lang").where("doc_id > 9000 or doc_id is null").collect()))
    assert seen[0] == [(-1, True), (9003, True), (9004, True), (9005, True), (9006, True), (9006, True), (9007, True)]
    # One of the rows that repeat 9006; its copy without an id comes after it, and 9007 is a near copy of 9005.
    assert seen[1] == [(9003, True), (9004, True), (9005, True), (9006, True)] or seen[1] == [(9004, True), (9005, True), (9006, True)]
    assert [x for x, _ in seen[2]] == [x for x, _ in seen[1] if x != 9004] and seen[3] == seen[2]
    last = corpus_pipeline.STAGES[4][1](spark, now, SIZE)
    assert last.columns == [c for c in odd.columns if c not in ("topic", "copies")] + ["topic", "weight", "copies"]
    assert corpus_pipeline.STAGES[4][1](spark, odd.limit(0), SIZE).count() == 0


def test_run_by_force(spark):
    """Each stage's kept rows against plain loops over what the stage before kept."""
    from test_hot_seeds import by_force

    docs = spark.read.parquet(f"{SIZE}/documents.parquet")
    stages = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stages.append(stage(spark, stages[-1], SIZE).cache())
    texts = [{r.doc_id: r.text for r in s.collect()} for s in stages]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts[1].items()}
    first = {}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and (sets[i] or not sets[j]):
                first[i] = min(first.get(i, i), first.get(j, j))
    assert texts[2].keys() == {i for i in sets if i not in first}
    items = [r.text for r in spark.read.parquet(f"{SIZE}/benchmark.parquet").orderBy("item_id").collect()]
    ids = sorted(texts[2])
    hit = {ids[k] for k, _ in by_force([texts[2][i] for i in ids], items)}
    assert texts[3].keys() == set(ids) - hit and hit
    assert texts[4].keys() == texts[3].keys()
    assert set(texts[5]) <= set(texts[4]) and all(texts[5][i] == texts[4][i] for i in texts[5])
    rows = stages[5].collect()
    assert all(r.copies in (int(r.weight), int(r.weight) + 1) and r.copies > 0 for r in rows)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SIZE).collect()) == sorted(texts[5])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SIZE}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SIZE)
    found = con.execute(queries.ORACLE_SQL[name])
    at = sorted(range(len(found.description)), key=lambda k: found.description[k][0])
    assert [found.description[k][0] for k in at] == sorted(got.columns)
    assert sorted(repr([r[c] for c in sorted(got.columns)]) for r in got.collect()) == sorted(repr([r[k] for k in at]) for r in found.fetchall())
