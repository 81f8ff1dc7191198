"""Small cases of the library's operators, with values worked out by hand or by plain folds."""

import datetime
import hashlib
import hmac
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import paths, retry, text
from sparkloom.functions.vectors import cosine_similarity
from sparkloom.operators import corpus, diff, evalsplit, findings, groundtruth, metrics, report, retrieval, reviews
from sparkloom.sources import pages, webhooks
from sparkloom.streaming import claims

DIFF = """diff --git a/app/x.py b/app/x.py
index 1..2 100644
--- a/app/x.py
+++ b/app/x.py
@@ -1,3 +10,4 @@ def first():
 keep this line of context
+added one line here
-removed another line
diff --git a/tests/y.ts b/tests/y.ts
--- a/tests/y.ts
+++ b/tests/y.ts
@@ -1 +7 @@
+a line in the second file of all
"""


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, same=cosine_similarity(v(1.0, 2.0), v(2.0, 4.0)), across=cosine_similarity(v(1.0, 0.0), v(0.0, 3.0)), zero=cosine_similarity(v(0.0, 0.0), v(1.0, 1.0)))
    assert r.same == pytest.approx(1) and r.across == 0 and r.zero == 0


@pytest.mark.parametrize("how, owners", [("compat", ["tests/y.ts", "tests/y.ts"]), ("strict", ["app/x.py", "tests/y.ts"])])
def test_hunks(spark, how, owners):
    rows = diff.split_hunks(spark.createDataFrame([(1, DIFF), (2, "@@ -1 +1 @@\n+x"), (3, None)], "id int, diff string"), "id", "diff", how).orderBy("pos").collect()
    assert [r.path for r in rows] == owners
    assert rows[0].hunk.startswith("@@ -1,3 +10,4 @@") and "+++ b/" not in rows[0].hunk


def test_diff_summary(spark):
    counts = diff.line_counts(spark.createDataFrame([(1, DIFF)], "id int, diff string"), "id", "diff")
    s = diff.summarize(counts, "id")
    r = s.select("*", diff.overview(s).alias("overview")).first()
    assert (r.file_count, r.added, r.removed, r.test_files) == (2, 2, 1, ["tests/y.ts"])
    assert r.overview.splitlines() == ["**Changed areas (2 files; +2/-1 lines):**", "- `app/x.py (+1/-1)`", "- `tests/y.ts (+1/-0)`", "**Test files changed:** `tests/y.ts`"]


def test_starting_line_and_preview(spark):
    hunk = "@@ -1 +5 @@\n+import os\n+value = 1\n+\n+\"\"\"\n+inside\n+\"\"\"\n context\n" + "\n".join(f"+x{i}" for i in range(9))
    r = one(spark, a=diff.starting_line(F.lit("@@ -10,6 +25,9 @@ f")), b=diff.starting_line(F.lit("@@ -1 +7 @@")), c=diff.starting_line(F.lit("none")), p=diff.relevant_lines(F.lit(hunk)))
    assert (r.a, r.b, r.c) == (25, 7, None)
    assert r.p == "value = 1\n" + "\n".join(f"x{i}" for i in range(7)) + "\n... (2 more lines)"


def test_paths(spark):
    cases = {"a/b.PY": ".py", ".bashrc": "", "x/.env.Local": ".local", "noext": "", "dot.": "", "a.tar.gz": ".gz"}
    rows = spark.createDataFrame(list(cases.items()), "p string, want string").select("p", "want", paths.suffix(F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    r = one(spark, a=paths.is_test_path(F.lit("src/Tests/a")), b=paths.is_test_path(F.lit("a.spec.ts")), c=paths.is_test_path(F.lit("contest.py")), l=paths.language(F.lit("a.b.yml")), n=paths.language(F.lit("Makefile")))
    assert (r.a, r.b, r.c, r.l, r.n) == (True, True, False, "yaml", "")


def test_first_of_each_body(spark):
    rows = spark.createDataFrame([(1, 1, "Same "), (1, 2, "other"), (1, 3, "\tsame")], "query_id int, nth int, body string")
    assert [r.nth for r in retrieval.first_of_each_body(rows, "body", [F.asc("nth")]).orderBy("nth").collect()] == [1, 2]


def test_live_retrieval_prefers_shared_identifiers(spark):
    past = spark.createDataFrame([(1, "o", "r", "a.py", "x", "plain", [1.0, 0.0]), (2, "o", "r", "a.py", "use MAX_SIZE", "bound", [0.99, 0.1]), (3, "o", "r", "a.py", "x", "far", [0.0, 1.0])], "github_comment_id long, repo_owner string, repo_name string, path string, diff_hunk string, body string, embedding array<double>")
    asked = spark.createDataFrame([(7, "@@ -1 +1 @@ MAX_SIZE is used in here", "b.py", "o", "r", [1.0, 0.0]), (8, "short", "b.py", "o", "r", [1.0, 0.0])], "query_id long, hunk string, path string, repo_owner string, repo_name string, vector array<double>")
    rows = retrieval.similar_comments(asked, past).orderBy("query_id", "nth").collect()
    assert [(r.query_id, r.github_comment_id, r.nth) for r in rows] == [(7, 2, 1), (7, 1, 2)]


def test_queries_in_blocks_give_the_same(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.withColumnRenamed("id", "query_id")
    whole, cut = (sorted(map(tuple, retrieval.top_similar(q, v, 3, block_bytes=b).select("query_id", "id", "nth").collect())) for b in (1 << 20, 256))
    assert whole == cut and len(whole) == 180


def test_metrics_nulls(spark):
    rows = metrics.precision_recall_f1(spark.createDataFrame([(3, 1, 1), (0, 0, 5), (0, 2, 0)], "tp int, fp int, fn int")).collect()
    assert [(r.precision, r.recall, r.f1) for r in rows] == [(0.75, 0.75, 0.75), (None, 0.0, None), (0.0, None, None)]


def test_scores(spark):
    samples = spark.createDataFrame([(True, 2, 0.9, True), (True, 1, 0.3, True), (False, 0, 0.0, None), (True, 0, 0.9, True), (True, 1, 0.8, False)], "had_retrieval boolean, num_concerns int, best_similarity double, judge_confirmed boolean")
    swept = metrics.sweep(samples, (0.5,)).first()
    assert (swept.tp, swept.fp, swept.fn) == (2, 2, 3)
    final = metrics.final_score(samples, 0.5).first()
    assert (final.tp, final.fp, final.fn) == (1, 3, 4)
    none = metrics.sweep(samples.where("not had_retrieval"))
    assert metrics.best_threshold(none).first().floor == 0.45


def test_split(spark):
    rows = [(s, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)) for s, n in (("a", 20), ("b", 4), ("c", 8)) for i in range(n)]
    pool = spark.createDataFrame(rows, "repo string, id int, at timestamp")
    got = evalsplit.stratified_split(pool, ["repo"], ["at", "id"], 15, 35, 10).collect()
    tune, test = ({(r.repo, r.id) for r in got if r.part == p} for p in ("tune", "test"))
    assert not tune & test
    k = {"tune": 5, "test": 11}
    for name, n in (("a", 20), ("b", 4), ("c", 8)):
        for part, ids in (("tune", list(range(n // 2))), ("test", list(range(n // 2, n)))):
            want = ids if len(ids) <= k[part] else [ids[int(i * len(ids) / k[part])] for i in range(k[part])]
            assert sorted(i for s, i in (tune if part == "tune" else test) if s == name) == want
    with pytest.raises(ValueError):
        evalsplit.stratified_split(pool.where("repo = 'b'"), ["repo"], ["at", "id"])


def test_even_subsample_against_a_fold(spark):
    for n in (1, 7, 22, 97, 1000):
        rows = spark.range(n).withColumn("g", F.lit(1))
        for k in (1, 3, 7, 35):
            got = sorted(r.id for r in evalsplit.even_subsample(rows, ["g"], ["id"], k).collect())
            assert got == (list(range(n)) if n <= k else sorted({int(i * (n / k)) for i in range(k)}))


def test_corpus(spark):
    api = spark.createDataFrame([(1, "u/pulls/12", "a.py", None, 4, "@@", "note [automated review]", ("ann",), "2024-05-01T10:00:00Z", None), (2, "u/pulls/13", "a.py", 3, 4, "@@ x", "fine", None, "2024-05-01T12:00:00+02:00", "h"), (3, "u/pulls/13", "a.py", 3, 4, "  ", "blank", ("bob",), None, None)], "id long, pull_request_url string, path string, line int, original_line int, diff_hunk string, body string, user struct<login: string>, created_at string, html_url string")
    rows = {r.github_comment_id: r for r in corpus.projected(api).collect()}
    assert (rows[1].pr_number, rows[1].line, rows[2].line) == (12, 4, 3)
    assert rows[1].comment_created_at == rows[2].comment_created_at == datetime.datetime(2024, 5, 1, 10)
    assert corpus.projected(api, public=True).where("github_comment_id = 2").first().author == "unknown"
    assert [r.id for r in corpus.worth_keeping(api).collect()] == [2]
    known = spark.createDataFrame([(2,)], "id long")
    assert tuple(corpus.accounting(api.union(api), known, "id").first()) == (2, 4)


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    corpus.insert_if_absent(spark.createDataFrame([(1, "a")], "id long, v string"), path, "id")
    new = spark.createDataFrame([(1, "x"), (2, "b"), (2, "b")], "id long, v string")
    assert tuple(corpus.insert_if_absent(new, path, "id").first()) == (1, 2)
    assert tuple(corpus.insert_if_absent(new, path, "id").first()) == (0, 3)
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "v").collect())) == [(1, "a"), (2, "b")]


def test_evidence_budget(spark):
    rows = spark.createDataFrame([(1, i, "x" * 100) for i in range(7)], "id int, at int, line string")
    got = [len(r.line) for r in findings.within_budget(rows, "id", [F.col("at")], "line", 5, 300).orderBy("at").collect()]
    left, want = 300, []
    for i in range(5):
        room = 300 - sum(n + 1 for n in want) - (1 if i else 0)
        if room <= 0:
            break
        want.append(min(100, room))
    assert got == want and left == 300


def test_validation(spark):
    reply = '{"concerns": [{"concern": " c ", "evidence": "e", "source_indices": [-1, 0, 99], "confidence": "NaN", "is_inference": true}, {"concern": "d", "evidence": "e", "source_indices": [99]}, {"concern": "", "evidence": "e", "source_indices": [0]}, {"concern": "x", "evidence": " ", "source_indices": [0]}]}'
    rows = findings.validated(spark.createDataFrame([(reply, ["s0"]), ("no json", ["s0"]), (None, None)], "reply string, candidates array<string>")).collect()
    assert [(r.concern, r.source_comments, r.confidence, r.is_inference) for r in rows] == [("c", ["s0"], None, True)]


def test_contradiction(spark):
    ctx = "import { MAX_SIZE }\n from './a';\nexport const MAX_SIZE = 1"
    c = lambda claim, mine=ctx, every=ctx: findings.contradicted(F.lit(claim), F.lit(mine), F.lit(every))
    r = one(spark, yes=c("MAX_SIZE is not imported"), typed=c("MAX_SIZE has implicit any"), other=c("MAX_SIZE may overflow"), nobody=c("it is undefined"), elsewhere=c("MAX_SIZE is undefined", "const x = 1"))
    assert (r.yes, r.typed, r.other, r.nobody, r.elsewhere) == (True, True, False, False, False)


def test_findings_merge(spark):
    rows = spark.createDataFrame([(1, 0, "MAX_SIZE is not imported here", False, 0.5, ["a"]), (1, 1, "missing import of MAX_SIZE", False, 0.75, ["b", "a"]), (1, 2, "MAX_SIZE lacks type information", False, 0.9, ["c"]), (2, 0, "Same", False, None, ["a"]), (2, 1, "same ", True, None, ["b"])], "review_id int, pos int, concern string, is_inference boolean, confidence double, source_key array<string>")
    got = findings.union_of_evidence(rows, findings.merged(rows)).orderBy("review_id", "pos").collect()
    assert [(r.review_id, r.pos, r.n_merged, r.confidence, r.sources) for r in got] == [(1, 0, 2, 0.75, ["a", "b"]), (1, 2, 1, 0.9, ["c"]), (2, 0, 1, None, ["a"]), (2, 1, 1, None, ["b"])]


def test_clusters_do_not_merge(spark):
    rows = spark.createDataFrame([(1, 0, ["A"], ["x"]), (1, 1, ["B"], ["y"]), (1, 2, ["A", "B"], ["x", "y"]), (1, 3, ["B"], ["y"]), (1, 4, None, ["x"])], "review_id int, pos int, symbols array<string>, evidence array<string>")
    assert [r.cluster_pos for r in findings.clusters(rows).orderBy("pos").collect()] == [0, 1, 0, 0, 4]


def test_native_pair_rule_agrees_with_the_fold(spark):
    concerns = ["", "MAX_SIZE undefined", "undefined MAX_SIZE again", "the handler may leak memory on error paths", "the handler could leak memory on error paths", "quite another thing"]
    pairs = spark.createDataFrame([(a, b) for a in concerns for b in concerns], "a string, b string")
    ratio = F.udf(lambda a, b: SequenceMatcher(None, a or "", b or "").ratio(), "double")(F.lower(text.strip(F.col("a"))), F.lower(text.strip(F.col("b"))))
    for r in pairs.select("a", "b", findings.same_finding(F.col("a"), F.col("b"), F.lit(False), F.lit(False), ratio).alias("same")).collect():
        assert r.same == findings._Concern(r.a, False).same(findings._Concern(r.b, False)), (r.a, r.b)


def test_provider_failure_is_data(spark):
    asked = spark.createDataFrame([(1, "h")], "id int, hunk string")

    def broken(rows):
        raise RuntimeError("quota")

    r = findings.synthesized(asked, broken, "id int, hunk string", ["hunk"]).first()
    assert r.failed and r.reply is None and r.error == "quota"
    assert not findings.synthesized(asked, lambda rows: ["{}" for _ in rows], "id int, hunk string", ["hunk"]).first().failed


def test_ground_truth(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9, True, "yes"), (1, 11, 0.8, False, "no"), (2, 12, 0.4, True, "yes"), (3, 13, 0.7, False, "no"), (3, 14, 0.6, True, "yes")], "comment_id int, prediction_id int, similarity double, same_concern boolean, judge_reason string")
    got = {r.prediction_id: (r.matched, r.match_reason, r.source_comment_id) for r in groundtruth.judged(pairs).collect()}
    assert got == {10: (True, "yes", 1), 11: (None, None, None), 12: (False, "below_similarity_floor", None), 13: (False, "no", None), 14: (False, "no", None)}


def test_next_page(spark):
    r = one(spark, a=pages.next_page_url(F.lit('<u?page=1>; rel="prev", <u?page=3>; rel="next"')), b=pages.next_page_url(F.lit('<u>; rel="last"')), c=pages.next_page_url(F.lit(None).cast("string")))
    assert (r.a, r.b, r.c) == ("u?page=3", None, None)


def test_paginate():
    data = {"u": ([{"i": 1}, {"i": 2}], "v"), "v": ([{"i": 3}, {"i": 4}], "v")}
    get = lambda url, params: data[url]
    assert [x["i"] for x in pages.paginate(get, "u", {"per_page": 2})] == [1, 2, 3, 4]
    assert [x["i"] for x in pages.paginate(get, "u", {"per_page": 2}, 3)] == [1, 2, 3]
    assert [x["i"] for x in pages.paginate(get, "u", {"per_page": 5})] == [1, 2]
    with pytest.raises(RuntimeError):
        list(pages.paginate(lambda u, p: ({"error": 1}, None), "u"))


def test_signature(spark):
    good = "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("ping", good, "{}"), ("ping", "sha256=0", "{}"), ("ping", None, "{}")], "event string, signature string, payload string")
    assert [r.kind for r in webhooks.dispatched(rows, "k").collect()] == ["pong", "unauthorized", "unauthorized"]


def test_retry_after(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    r = one(spark, a=retry.retry_after_seconds(F.lit("12.5"), now), b=retry.retry_after_seconds(F.lit("Thu, 01 Feb 2024 00:00:30 GMT"), now), c=retry.retry_after_seconds(F.lit("x"), now), d=retry.retry_after_seconds(F.lit("-3"), now))
    assert (r.a, r.b, r.c, r.d) == (12.5, 30.0, None, 0.0)


def test_report(spark):
    source = F.struct(F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"), F.lit("x.py").alias("path"), F.lit("a|b\nc").alias("body"), F.lit(0.876).alias("similarity"), F.lit("http://h").alias("html_url"), F.lit("x.py").alias("triggered_by_file"), F.lit("@@ -1 +4 @@\n+go()").alias("triggered_by_hunk"))
    f = F.struct(F.lit("leak").alias("concern"), F.lit("seen").alias("evidence"), F.lit(0.57).alias("confidence"), F.lit("look").alias("suggested_check"), F.lit(False).alias("is_inference"), F.array(source).alias("source_comments"))
    body = one(spark, r=report.report(F.array(f), F.lit(1), F.lit(2), F.lit("completed_with_findings"), F.lit(True), F.lit("note"), F.lit("sum"))).r
    for part in ("*2 hunks scanned · 1 similar past pattern matched*", "### Finding 1: leak", "**Location:** `x.py` · line 4", "(uncalibrated):** 56% |", "```python\ngo()\n```", "(1 match):**", '| 88% | `o/r` | `x.py` | *"a\\|b c"* | [view](http://h) |', "**Analysis status:** note", "Only a part of this change"):
        assert part in body, part
    none = one(spark, r=report.report(F.array().cast("array<" + spark.range(1).select(f.alias("f")).schema["f"].dataType.simpleString() + ">"), F.lit(0), F.lit(1), F.lit("general_analysis_only"), F.lit(False), F.lit(""), F.lit(""))).r
    assert "No past comment on similar code" in none and "1 hunk scanned" in none


def test_rank_order_and_caps(spark):
    g = spark.createDataFrame([(1, "b", "h", [0.1, 0.9]), (1, "a", "h", [0.9]), (1, "c", "h", None)], "review_id int, filepath string, hunk string, scores array<double>")
    rows = reviews.ordered_groups(g)
    assert [r.filepath for r in rows.orderBy("pos").collect()] == ["a", "b", "c"]
    done = rows.where("filepath = 'a'").select("review_id", "review_key")
    left = reviews.to_do(rows, done, limit=1).collect()
    assert [(r.filepath, r.truncated) for r in left] == [("b", True)]


def event(action, at, **more):
    return {"action": action, "at": float(at)} | more


def run(events):
    state, out = None, []
    for e in events:
        state, result, dead = claims.step(state, e)
        out.append(result)
    return state, out, dead


def test_claims():
    state, out, _ = run([event("claim", 0), event("claim", 1), event("acquire", 2, task_id="t", worker="w"), event("acquire", 3, task_id="u", worker="x"), event("checkpoint", 4, worker="x", value="p"), event("checkpoint", 5, worker="w", value="p"), event("finish", 6, worker="w", value="completed_no_findings")])
    assert out == ["queued", "duplicate_skipped", "acquired", "refused", "fenced", "saved", "finished"]
    assert state["status"] == "completed_no_findings" and state["payload"] == "p"
    state, out, _ = run([event("claim", 0), event("acquire", 0, task_id="t", worker="w"), event("acquire", 1200, task_id="u", worker="x"), event("finish", 1201, worker="w"), event("close", 1202), event("claim", 1203, allow_reclaim=False), event("claim", 1204, allow_reclaim=True)])
    assert out == ["queued", "acquired", "acquired", "fenced", "released", "duplicate_skipped", "queued"] and state["attempts"] == 0


def test_recovery_ends_in_a_dead_letter():
    state, at, dead = None, 0.0, None
    state, _, _ = claims.step(None, event("claim", at))
    for n in range(claims.MAX_ATTEMPTS):
        state, result, _ = claims.step(state, event("acquire", at, task_id="t", worker="w"))
        assert result == "acquired" and state["attempts"] == n + 1
        at += claims.LEASE
        state, result, dead = claims.step(state, event("tick", at))
    assert result == "failed" and dead and state["status"] == "failed"
    assert claims.step(state, event("acquire", at, task_id="t", worker="w"))[1] == "refused"
    assert claims.step(state, event("requeue", at))[0]["attempts"] == 0


def test_first_claims_stream(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a", base), ("a", base), ("b", base)], "k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    s = claims.first_claims(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), ["k"], "ts")
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_query_value_and_pull_comments(spark):
    urls = [("rediss://h:1/0", "rediss://h:1/0?c=R"), ("rediss://h/0?a=1&c=old&b=#x", "rediss://h/0?a=1&c=R#x"), ("redis://h/0", "redis://h/0"), (None, None)]
    df = spark.createDataFrame(urls, "url string, want string")
    assert all(r.got == r.want for r in df.select("want", pages.with_query_value(F.col("url"), "c", "R", "rediss").alias("got")).collect())
    rows = spark.createDataFrame([(1, "https://x/repos/o/r/pulls/1"), (2, "https://x/repos/o/r/pulls/11"), (3, None)], "id int, pull_request_url string")
    assert [r.id for r in pages.comments_of_pull(rows, "o", "r", 1).collect()] == [1]


def test_vectors_of_other_lengths_match_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [0.0, 0.0]), (6, [0.0, 1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None), (7, [])], "query_id long, vector array<double>")
    for size in (1 << 20, 8):
        assert sorted((r.query_id, r.id, r.nth) for r in retrieval.top_similar(q, v, 2, block_bytes=size).collect()) == [(9, 1, 1), (9, 5, 2)]
    assert retrieval.top_similar(q.where("vector is null"), v, 2).collect() == []
    with pytest.raises(ValueError):
        retrieval.top_similar(v.where("id < 3").withColumnRenamed("id", "query_id"), v, 2)


def test_replay_of_many_claims_and_a_long_one(spark):
    rng = random.Random(5)
    actions = ["claim", "acquire", "checkpoint", "tick", "finish", "retry", "fail", "close", "assert"]
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 400), i, float(i // 3 * 500), rng.choice(actions), "t", "w", "x", rng.random() < 0.5, False) for i in range(5000)]
    table = spark.createDataFrame(rows, "claim_key long, seq long, at double, action string, task_id string, worker string, value string, allow_reclaim boolean, redelivered boolean")
    want, states = [], {}
    for key, seq, at, action, *rest in rows:  # already in order
        e = dict(zip(claims.EVENT, (at, action, rest[0], rest[1], rest[2], rest[3], rest[4])))
        states[key], result, dead = claims.step(states.get(key), e)
        want.append((key, seq, result, states[key] and states[key]["status"], dead))
    got = claims.replayed(table.repartition(7), "claim_key").select("claim_key", "seq", "result", "status", "dead_letter").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_identifiers_end_at_letters_outside_ascii(spark):
    df = spark.createDataFrame([("\u00c9ELLEQUE, ANREELLE\u00c8 _ABCD ABCD9_ xTAIL ABC",)], "t string")
    assert df.select(text.identifiers(F.col("t"))).first()[0] == ["ELLEQUE", "ANREELLE", "ABCD9_"]


def test_equal_vectors_tie_wherever_they_lie(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((37, 64)).astype("float32").astype(float)] * 90)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>").repartition(3)
    got = retrieval.top_similar(v.where("id % 111 = 0").withColumnRenamed("id", "query_id"), v, 100).orderBy("query_id", "nth").collect()
    for q in range(0, len(x), 111):
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 100 and [r.id for r in mine[:90]] == list(range(q % 37, len(x), 37))
        assert len({r.similarity for r in mine}) == 2


def test_search_holds_small_tiles(monkeypatch):
    seen = []
    real = retrieval.np.partition
    monkeypatch.setattr(retrieval.np, "partition", lambda a, *rest, **more: (seen.append(a.size), real(a, *rest, **more))[1])
    x = np.random.default_rng(2).standard_normal((5000, 4))
    side = lambda name, n: pa.table({name: pa.array(range(n)), "vector": pa.array(x[:n].tolist())})
    found = sum(b.num_rows for b in retrieval.best_rows(side("query_id", 600), side("id", 5000), 4, -1.0, 3, False))
    assert found == 600 * 3 * 2 and max(seen) <= 256 * 4096
