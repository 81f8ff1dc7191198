"""Requests that filters become, and a list that is read on as a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.rest import Diffs, ListStream, ReviewComments

PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def service(tmp_path, spark):
    """A service in files, so that tasks and driver see the same list; each request leaves a line."""
    log, size = tmp_path / "log", tmp_path / "size"
    size.write_text("0")

    class Client:
        @staticmethod
        def page(url, params):
            with open(log, "a") as f:
                f.write(json.dumps([url, params.get("page")]) + "\n")
            if params.get("accept") == "diff":
                return f"diff of {url}", None
            n = int(size.read_text())
            if "page" in params:
                k, per = params["page"] - 1, params["per_page"]
                return [{"n": i} for i in range(k * per, min(n, (k + 1) * per))], None
            pull = int(url.split("/")[-2]) if url.count("/") == 6 else None
            items = [{"id": i, "pull_request_url": f"https://x/pulls/{pull if pull is not None else i % 3}"} for i in range(n)]
            first = int(url.rpartition("#")[2]) if "#" in url else 0
            per = params.get("per_page", 100)
            return items[first : first + per], (f"{url.partition('#')[0]}#{first + per}" if first + per < n else None)

        @staticmethod
        def count(url, params):
            return int(size.read_text())

    before = spark.conf.get(PUSH, "false")
    spark.conf.set(PUSH, "true")
    for kind in (ReviewComments, Diffs, ListStream):
        spark.dataSource.register(type(kind.__name__, (kind,), {"client": Client}))
    yield log, size
    spark.conf.set(PUSH, before)


def requests(log):
    return [json.loads(x) for x in log.read_text().splitlines()] if log.exists() else []


def test_a_pull_is_one_list(spark, service):
    log, size = service
    size.write_text("7")
    df = spark.read.format("review_comments").option("per_page", "3").load().where("owner = 'o' and repo = 'r' and pr_number = 12")
    got = df.where(F.get_json_object("item", "$.id").cast("int") > 2).collect()
    assert {(r.owner, r.repo, r.pr_number) for r in got} == {("o", "r", 12)} and len(got) == 4
    assert {u.partition("#")[0] for u, _ in requests(log)} == {"/repos/o/r/pulls/12/comments"}


def test_some_pulls_are_a_partition_each(spark, service):
    log, size = service
    size.write_text("2")
    df = spark.read.format("review_comments").load().where("owner = 'o' and repo = 'r' and pr_number in (3, 5)")
    assert df.rdd.getNumPartitions() == 2 and df.count() == 4
    assert {u for u, _ in requests(log)} == {"/repos/o/r/pulls/3/comments", "/repos/o/r/pulls/5/comments"}
    assert spark.read.format("review_comments").load().where("owner = 'o' and repo = 'r' and pr_number = 3 and pr_number = 5").count() == 0
    with pytest.raises(Exception, match="owner"):
        spark.read.format("review_comments").load().count()


def test_public_lists(spark, service):
    log, size = service
    size.write_text("2105")
    read = spark.read.format("review_comments").option("public", "true")
    where = "owner = 'o' and repo = 'r'"
    assert read.load().where(where).count() == 0 and not requests(log)
    assert read.option("token", "t").load().where(where).count() == 2000
    assert read.option("token", "t").option("max_items", "50").load().where(where).count() == 50
    assert {r.pr_number for r in read.option("token", "t").option("max_items", "9").load().where(where).collect()} == {0, 1, 2}


def test_diffs_by_heads_or_by_pull(spark, service):
    log, _ = service
    df = spark.read.format("diffs").option("owner", "o").option("repo", "r").load()
    assert df.where("before_sha = 'a' and after_sha in ('b', 'c')").count() == 2
    assert {u for u, _ in requests(log)} == {"/repos/o/r/compare/a...b", "/repos/o/r/compare/a...c"}
    row = df.where("pr_number = 4").first()
    assert (row.pr_number, row.before_sha, row.diff) == (4, None, "diff of /repos/o/r/pulls/4")
    with pytest.raises(Exception, match="after_sha"):
        df.where("before_sha = 'a'").count()


def run(spark, tmp_path, **options):
    stream = spark.readStream.format("rest_list_stream").options(url="/list", per_page="10", **options).load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert q.exception() is None
    return sorted((r.position, json.loads(r.item)["n"]) for r in spark.read.schema("position long, item string").parquet(str(tmp_path / "out")).collect()) if os.path.exists(tmp_path / "out") else []


def test_restarts_read_no_full_page_again(spark, service, tmp_path):
    log, size = service
    size.write_text("35")
    assert run(spark, tmp_path) == [(i, i) for i in range(35)]
    assert sorted(p for _, p in requests(log)) == [1, 2, 3, 4]
    assert run(spark, tmp_path) == [(i, i) for i in range(35)] and len(requests(log)) == 4
    size.write_text("52")
    assert run(spark, tmp_path) == [(i, i) for i in range(52)]
    assert sorted(p for _, p in requests(log)[4:]) == [4, 5, 6], "the page that was not full yet, and the new ones"


def test_stream_limits(spark, service, tmp_path):
    log, size = service
    size.write_text("35")
    assert run(spark, tmp_path / "a", public="true") == [] and not requests(log)
    assert len(run(spark, tmp_path / "b", public="true", token="t", max_items="12")) == 12
    size.write_text("2300")
    assert len(run(spark, tmp_path / "c", public="true", token="t")) == 2000
