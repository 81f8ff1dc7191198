"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` but the smallest of its component.

    component is the smallest node reachable. Loops, nulls and repeated edges are ignored; no edges give no
    rows. Each round is two aggregations with map-side minima and joins that Spark may split on hot nodes; its
    edges are written to the shared folder, so lost executors cost one round at most. The rounds needed grow with
    the square of the logarithm of the longest chain; passing ``max_rounds`` is an error, never a cut.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e, seen = written(e, "edges"), None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        lower = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = written(lower.union(small.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
