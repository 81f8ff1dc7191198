"""Ground truth as a stream: comments close the predictions they confirm or refute, each at most once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sparkloom.operators import groundtruth
from sparkloom.sinks import keyed

VERDICT = ["matched", "match_type", "source_comment_id", "match_reason", "batch"]


@dataclass(frozen=True)
class GroundTruth:
    """A sink for ``foreachBatch`` over comments (comment_id, path, line, ...): it judges open predictions and keeps what none is near.

    ``judge`` gives candidate pairs their similarity, same_concern and judge_reason. ``predictions`` and ``misses`` are keyed tables
    (``sinks.keyed``), by prediction_id and by comment_id.

    A verdict carries the number of its batch. A batch sees the predictions as they were before it: a verdict of its own number counts
    as open. So a batch that runs again, after a crash between the two writes or after both, decides the same and changes nothing.
    """

    predictions: str
    misses: str
    judge: Callable[[DataFrame], DataFrame]
    place: tuple[str, ...] = tuple(groundtruth.PLACE)
    buckets: int = 64

    def open(self, predictions: DataFrame, known: DataFrame) -> dict[str, int]:
        """Adds ``predictions`` that are not known yet; a verdict they come with is of no batch."""
        columns = {c: F.lit(None).cast(kind) for c, kind in (("matched", "boolean"), ("match_type", "string"), ("source_comment_id", "long"), ("match_reason", "string"), ("batch", "long")) if c not in known.columns}
        return keyed.upsert(predictions.withColumns(columns), self.predictions, ["prediction_id"], "absent", self.buckets)

    def before(self, spark, batch_id: int) -> DataFrame:
        ours = F.coalesce(F.col("batch") >= batch_id, F.lit(False))
        rows = keyed.stored(spark, self.predictions)
        return rows.withColumns({c: F.when(~ours, F.col(c)) for c in VERDICT})

    def __call__(self, comments: DataFrame, batch_id: int) -> None:
        spark, place = comments.sparkSession, list(self.place)
        seen = self.before(spark, batch_id)
        pairs = self.judge(groundtruth.candidate_pairs(comments, seen.select("prediction_id", *place, "predicted_line", "matched", *(["concern"] if "concern" in seen.columns else [])), place))
        states = groundtruth.judged(pairs).where("matched is not null").withColumn("batch", F.lit(batch_id).cast("long"))
        verdicts = states.select("prediction_id", F.col("source_comment_id").cast("long").alias("source_comment_id"), "matched", "match_type", "match_reason", "batch")
        missed = groundtruth.false_negatives(comments, seen, place)
        # Misses first: they are found on the predictions as they were, which the second write would change for a plan read late.
        keyed.upsert(missed, self.misses, ["comment_id"], "absent", self.buckets)
        whole = seen.drop(*VERDICT, keyed.BUCKET).join(verdicts, "prediction_id").select(*(c for c in seen.columns if c != keyed.BUCKET))
        keyed.upsert(whole, self.predictions, ["prediction_id"], "replace", self.buckets)
