"""The stored vector index as queries: what it finds, and how much of the exact answer that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.retrieval import top_similar
from sparkloom.operators.vector_index import build_index, search_index
from sparkloom.plans import tables as t
from sparkloom.plans.registry import query
from sparkloom.streaming.running import shared_folder


def _found(spark, d) -> DataFrame:
    path = shared_folder(spark, "vector_index")
    build_index(t.vectors(spark, d).select("id", "vector"), path)
    return search_index(spark, path, t.vector_queries(spark, d), 20, exclude_self=True)


@query("j1_approximate_topk")
def approximate(spark, d):
    return _found(spark, d).withColumn("similarity", F.round("similarity", 9))


@query("j1_index_recall")
def recall(spark, d):
    """For each query, how many of the exact 20 nearest the index finds."""
    exact = top_similar(t.vector_queries(spark, d), t.vectors(spark, d), 20, exclude_self=True).select("query_id", "id")
    found = _found(spark, d).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
