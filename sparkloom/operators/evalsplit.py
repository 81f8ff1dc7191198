"""Held-out evaluation: pools, chronological halves and even samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TUNE, TEST_MAX, TEST_MIN = 15, 35, 10


def held_out_pool(comments: DataFrame, split_date, with_bots: bool = False) -> DataFrame:
    """Comments from ``split_date`` on (what retrieval may see is strictly before) by people."""
    late = comments.where(F.col("comment_created_at") >= F.lit(split_date))
    return late if with_bots else late.where(~F.col("author").endswith("[bot]"))


def pool_sizes(pool: DataFrame, by: list[str]) -> DataFrame:
    return pool.groupBy(*by).agg(F.count("*").alias("n_rows"))


def even_subsample(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """``k`` rows of each key, evenly spaced in ``order`` (all if there are no more); ``order`` has to be unique.

    The i-th row taken has place floor(i * (n / k)), in double arithmetic: place p is taken if some i gives p.
    """
    w = Window.partitionBy(*by)
    numbered = rows.withColumn("__at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    step = F.col("__n") / F.lit(float(k))
    first = F.ceil(F.col("__at") / step)
    taken = F.lit(False)
    for i in (first - 1, first, first + 1):  # rounding may move the index by one
        taken |= (i >= 0) & (i < k) & (F.floor(i.cast("double") * step) == F.col("__at"))
    return numbered.where((F.col("__n") <= k) | taken).drop("__at", "__n")


def stratified_split(pool: DataFrame, by: list[str], order: list[str], tune: int = TUNE, test_max: int = TEST_MAX, test_min: int = TEST_MIN) -> DataFrame:
    """``pool`` rows of the tune and test samples, with ``part``.

    Each stratum's earlier half may tune, its later half test; every stratum gives an equal quota (one at least), evenly
    spaced. Raises if there are fewer rows than ``tune`` + ``test_min``.
    """
    sizes = pool_sizes(pool, by).agg(F.sum("n_rows"), F.count("*")).first()
    if (sizes[0] or 0) < tune + test_min:
        raise ValueError(f"{sizes[0] or 0} rows cannot give {tune} to tune and {test_min} to test")
    w = Window.partitionBy(*by)
    halves = pool.withColumn("__at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("part", F.when(F.col("__at") < F.floor(F.count("*").over(w) / 2), "tune").otherwise("test")).drop("__at")
    quota = lambda total: max(1, total // sizes[1])
    parts = [even_subsample(halves.where(F.col("part") == p), by, order, quota(n)) for p, n in (("tune", tune), ("test", test_max))]
    return parts[0].unionByName(parts[1])
