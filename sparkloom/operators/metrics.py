"""Accuracy: counts, precision, recall and F1, and sweeps over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

THRESHOLDS = (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75)


def scoped(rows: DataFrame, owner: str | None = None, repo: str | None = None) -> DataFrame:
    """Rows of one repository if both names are given, else all."""
    return rows.where((F.col("repo_owner") == owner) & (F.col("repo_name") == repo)) if owner and repo else rows


def match_counts(matched: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("tp"), F.count_if(~matched).alias("fp"), F.count_if(matched.isNull()).alias("open")]


def precision_recall_f1(counts: DataFrame, digits: int | None = 3) -> DataFrame:
    """``counts`` (tp, fp, fn, ...) with precision, recall and f1; null where undefined. F1 is of the rounded two."""
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    out = counts.withColumn("precision", cut(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)))).withColumn("recall", cut(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", cut(2 * p * r / F.nullif(p + r, F.lit(0.0))))


def confusion(hit: Column, had: Column, n: Column) -> list[Column]:
    """tp, fp and fn of samples: one concern can be right, the others are wrong; a sample without any is a miss."""
    some = had & (n > 0)
    hit = F.coalesce(some & hit, F.lit(False))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [count(hit.cast("int")).alias("tp"), count(F.when(hit, n - 1).when(some, n).otherwise(0)).alias("fp"), count((~hit).cast("int")).alias("fn")]


def sweep(samples: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """The metrics of ``samples`` (had_retrieval, num_concerns, best_similarity) at each threshold, in one pass."""
    at = samples.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    counts = at.groupBy("threshold").agg(*confusion(F.col("best_similarity") >= F.col("threshold"), F.col("had_retrieval"), F.col("num_concerns")))
    return precision_recall_f1(counts)


def best_threshold(metrics: DataFrame) -> DataFrame:
    """The threshold of the highest F1; the lowest of equal ones, and the first of all if no F1 is defined."""
    return metrics.orderBy(F.desc_nulls_last("f1"), "threshold").limit(1).select(F.col("threshold").alias("floor"), "f1")


def final_score(samples: DataFrame, floor: float) -> DataFrame:
    hit = (F.col("best_similarity") >= floor) & F.coalesce(F.col("judge_confirmed"), F.lit(False))
    return precision_recall_f1(samples.agg(*confusion(hit, F.col("had_retrieval"), F.col("num_concerns"))).withColumn("floor", F.lit(floor)))


def sample_results(rows: DataFrame, floor: float | None = None) -> DataFrame:
    """``rows`` (had_retrieval, num_concerns, best_similarity, best_concern, judge_confirmed, judge_reason) as a run records them.

    Null flags and counts are false and zero. Without retrieval nothing was said; where nothing was said there is no similarity, else the
    best one to three digits, zero if none was over zero. Only with a ``floor``, and where the similarity before rounding reaches it, was
    the judge asked.
    """
    had = F.coalesce("had_retrieval", F.lit(False))
    said = F.when(had, F.coalesce("num_concerns", F.lit(0))).otherwise(0).cast("int")
    asked = (said > 0) & (F.col("best_similarity") >= floor) if floor is not None else F.lit(False)
    return rows.withColumns({
        "had_retrieval": had, "num_concerns": said,
        "best_similarity": F.when(said > 0, F.coalesce(F.round("best_similarity", 3), F.lit(0.0))),
        "best_concern": F.when(said > 0, F.col("best_concern")),
        "judge_confirmed": F.when(asked, F.col("judge_confirmed")),
        "judge_reason": F.when(asked, F.col("judge_reason")),
    })


def cold_start(samples: DataFrame) -> DataFrame:
    n = F.count_if(~F.col("had_retrieval"))
    return samples.agg(F.count("*").alias("n_samples"), n.alias("no_retrieval_match_count"), F.round(n / F.nullif(F.count("*"), F.lit(0)) * 100, 1).alias("no_retrieval_match_pct"))


def best_match(candidates: DataFrame, by: list[str], id_col: str, similarity: str = "similarity") -> DataFrame:
    """The most similar candidate over zero of each key, the lowest id of equal ones."""
    w = Window.partitionBy(*by).orderBy(F.desc(similarity), id_col)
    return candidates.where(F.col(similarity) > 0).withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
