"""How the driver's tables stand in for review data; each view has the same definition in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files; a name of one file has to be a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def events(spark, d) -> DataFrame:
    return with_k(table(spark, d, "events"))


def with_k(events: DataFrame) -> DataFrame:
    """Events with k, the number in their JSON."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def comments_at_lines(spark, d) -> DataFrame:
    return comments_of(events(spark, d))


def comments_of(events: DataFrame) -> DataFrame:
    """Errors and views as review comments: path by user, line by k."""
    e = events.where("event_type in ('error', 'view')")
    return e.select(F.col("event_id").alias("comment_id"), F.concat(F.lit("u"), F.col("user_id")).alias("path"), F.col("k").alias("line"))


def predictions_at_lines(spark, d) -> DataFrame:
    """Clicks and purchases as open predictions, sign-ups as judged ones; k of 7 has no line."""
    e = events(spark, d).where("event_type in ('click', 'purchase', 'signup')")
    return e.select(F.col("event_id").alias("prediction_id"), F.concat(F.lit("u"), F.col("user_id")).alias("path"), F.expr("nullif(k, 7)").alias("predicted_line"), F.when(F.col("event_type") == "signup", True).alias("matched"))


PLACED = (
    EVENTS
    + """, cm AS (SELECT event_id AS comment_id, 'u' || user_id AS path, k AS line FROM ev WHERE event_type IN ('error', 'view')),
pr AS (SELECT event_id AS prediction_id, 'u' || user_id AS path, nullif(k, 7) AS predicted_line, CASE WHEN event_type = 'signup' THEN true END AS matched FROM ev WHERE event_type IN ('click', 'purchase', 'signup')),
pairs AS (SELECT c.comment_id, c.path, c.line, p.prediction_id, p.predicted_line FROM cm c JOIN pr p ON c.path = p.path AND p.matched IS NULL AND (p.predicted_line IS NULL OR abs(p.predicted_line - c.line) <= 10))"""
)


def samples(spark, d) -> DataFrame:
    """Events as evaluation samples: similarity by value, concerns by user, the judge by k."""
    return samples_of(events(spark, d)).drop("best_concern", "real_comment")


def samples_of(events: DataFrame) -> DataFrame:
    """The same with what was said (the kind of event) and written (its JSON), and with ``part`` if it is there."""
    return events.select(
        *(c for c in events.columns if c == "part"), F.col("event_type").alias("best_concern"), F.col("props").alias("real_comment"), F.col("event_id").alias("sample_id"), (F.col("event_type") != "error").alias("had_retrieval"), F.pmod("user_id", F.lit(4)).cast("int").alias("num_concerns"), (F.col("value") / 500).alias("best_similarity"), (F.pmod("k", F.lit(2)) == 0).alias("judge_confirmed")
    )


SAMPLES = EVENTS + ", s AS (SELECT event_id AS sample_id, event_type <> 'error' AS had_retrieval, user_id % 4 AS num_concerns, value / 500 AS best_similarity, k % 2 = 0 AS judge_confirmed FROM ev)"


def diffs(spark, d) -> DataFrame:
    """A diff for each conversation: a file for each turn, its text as added (assistant) or removed lines."""
    sign = F.when(F.col("role") == "assistant", "+").otherwise("-")
    path = F.concat(F.col("role"), F.when(F.col("role") == "user", "/tests/a.py").otherwise("/src/b.ts"))
    body = F.concat(sign, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), sign)))
    part = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.format_string("\n@@ -%d,3 +%d,4 @@\n", F.col("turn") + 1, F.col("turn") + 2), body)
    from sparkloom.operators.diff import joined_in_order

    turns = table(spark, d, "conversations").select("conv_id", "turn", part.alias("part"))
    return joined_in_order(turns, ["conv_id"], "turn", "part", "\n").withColumnRenamed("context", "diff")


DIFFS = r"""dt AS (SELECT conv_id, turn, role || CASE WHEN role = 'user' THEN '/tests/a.py' ELSE '/src/b.ts' END AS path, CASE WHEN role = 'assistant' THEN '+' ELSE '-' END AS sign, text FROM conversations),
df AS (SELECT conv_id, string_agg('--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || (turn + 1) || ',3 +' || (turn + 2) || ',4 @@' || chr(10) || sign || replace(text, chr(10), chr(10) || sign), chr(10) ORDER BY turn, text) AS diff FROM dt GROUP BY conv_id),
ln AS (SELECT conv_id, unnest(string_split(diff, chr(10))) AS line, generate_subscripts(string_split(diff, chr(10)), 1) AS nr FROM df)"""


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, d) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return vectors(spark, d).where("id % 50 = 0").withColumnRenamed("id", "query_id")


PAIRS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
vp AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS q_label, c.label AS c_label, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) AS sim FROM e q JOIN e c ON q.vec_id % 50 = 0)"""


def past_comments(spark, d) -> DataFrame:
    """Documents with a vector, as a corpus of review comments."""
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    return rows.select(F.col("doc_id").alias("github_comment_id"), F.col("source").alias("repo_owner"), F.col("lang").alias("repo_name"), F.concat("source", F.lit("/a."), "lang").alias("path"), F.col("text").alias("diff_hunk"), F.col("text").alias("body"), "embedding")
