"""Predictions and the human comments that confirm or refute them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.operators.diff import starting_line

LINES, FLOOR = 10, 0.45
PLACE = ["repo_owner", "repo_name", "pr_number", "path"]


def predictions(reviews: DataFrame, path_from: str = "source") -> DataFrame:
    """A row a finding of ``reviews`` (repo_owner, repo_name, pr_number, finding): what is stored as a prediction.

    The path is that of the first past comment ("source", as ever) or of the changed file ("trigger"). A confidence may
    be null. matched starts as null: not judged yet.
    """
    first = F.get("finding.source_comments", F.lit(0))
    path = first["path"] if path_from == "source" else first["triggered_by_file"]
    return reviews.select(
        "repo_owner", "repo_name", "pr_number", F.coalesce(path, F.lit("")).alias("path"), starting_line(first["triggered_by_hunk"]).alias("predicted_line"),
        F.coalesce("finding.concern", F.lit("")).alias("concern"), F.col("finding.confidence").alias("confidence"), F.lit(None).cast("boolean").alias("matched"),
    )


def near(predicted_line: Column, comment_line: Column, lines: int = LINES) -> Column:
    """A prediction without a line is near any comment."""
    return predicted_line.isNull() | (F.abs(predicted_line - comment_line) <= lines)


def placed(comments: DataFrame) -> DataFrame:
    return comments.where("path <> '' and line is not null")


def candidate_pairs(comments: DataFrame, predictions: DataFrame, place: list[str] | None = None, lines: int = LINES) -> DataFrame:
    """Comments with the open predictions on their file within ``lines``: a hash join with a band as residue."""
    place = place or PLACE
    p = predictions.where("matched is null").drop("matched")
    return placed(comments).join(p, place).where(near(F.col("predicted_line"), F.col("line"), lines))


def false_negatives(comments: DataFrame, predictions: DataFrame, place: list[str] | None = None, lines: int = LINES) -> DataFrame:
    """Comments no open prediction is near to."""
    place = place or PLACE
    p = predictions.where("matched is null").select(*(F.col(c).alias(f"p_{c}") for c in place), "predicted_line")
    same = F.lit(True)
    for c in place:
        same &= F.col(c) == F.col(f"p_{c}")
    return placed(comments).join(p, same & near(F.col("predicted_line"), F.col("line"), lines), "left_anti")


def judged(pairs: DataFrame, floor: float = FLOOR) -> DataFrame:
    """The state of every candidate of ``pairs`` (comment_id, prediction_id, similarity, same_concern, judge_reason).

    The most similar candidate over zero is confirmed if it reaches ``floor`` and the judge agrees; the comment's others
    stay open then. Else all its candidates are refuted. A prediction near several comments goes to the confirmation
    of the lowest comment id, else to the refutation of the lowest.
    """
    ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("comment_id").orderBy(F.desc("similarity"), "prediction_id")))
    best = (F.col("nth") == 1) & (F.col("similarity") > 0) & (F.col("similarity") >= floor)
    won = F.coalesce(best & F.col("same_concern"), F.lit(False))
    reason = F.coalesce(F.max(F.when(best, F.col("judge_reason"))).over(Window.partitionBy("comment_id")), F.lit("below_similarity_floor"))
    confirmed = F.max(won).over(Window.partitionBy("comment_id"))
    state = ranked.withColumn("won", won).withColumn("matched", F.when(F.col("won"), True).when(~confirmed, False)).withColumn("match_reason", F.when(F.col("matched").isNotNull(), reason)).withColumn("match_type", F.when(F.col("won"), "embedding+judge"))
    first = F.row_number().over(Window.partitionBy("prediction_id").orderBy(F.desc_nulls_last("matched"), "comment_id"))
    return state.withColumn("__first", first).where("__first = 1").select("prediction_id", "matched", "match_type", F.when(F.col("won"), F.col("comment_id")).alias("source_comment_id"), "match_reason")


def updated(predictions: DataFrame, states: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """All predictions, those of ``states`` with their verdict; verdicts never overwrite earlier ones."""
    new = states.select(id_col, *(F.col(c).alias(f"new_{c}") for c in ("matched", "match_type", "source_comment_id", "match_reason")))
    open_ = F.col("matched").isNull()
    out = predictions.join(new, id_col, "left")
    for c in ("match_type", "source_comment_id", "match_reason"):
        out = out.withColumn(c, F.when(open_, F.col(f"new_{c}")).otherwise(F.col(c)) if c in predictions.columns else F.when(open_, F.col(f"new_{c}")))
    return out.withColumn("matched", F.coalesce("matched", "new_matched")).drop("new_matched", "new_match_type", "new_source_comment_id", "new_match_reason")
