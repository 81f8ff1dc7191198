"""The record of an evaluation run: one JSON text, written once under the time of the run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from sparkloom.operators import evalsplit, metrics

# The fields of a sample and of a score, in the order of a record.
SAMPLE_FIELDS = ("sample_id", "had_retrieval", "num_concerns", "best_similarity", "best_concern", "real_comment", "judge_confirmed", "judge_reason")
SCORE_FIELDS = ("tp", "fp", "fn", "precision", "recall", "f1")


def _sorted_list(rows: DataFrame, by: str, fields: tuple[str, ...]):
    """The rows as one array of structs in the order of ``by``, as a scalar subquery."""
    keyed = rows.select(F.struct(F.col(by).alias("__by"), F.struct(*fields).alias("row")).alias("r"))
    return keyed.agg(F.transform(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["__by"] < b["__by"], -1).when(a["__by"] > b["__by"], 1).otherwise(0)), lambda r: r["row"]).alias("rows")).scalar()


def run_record(pool: DataFrame, tune: DataFrame, test: DataFrame, run_at: datetime, split_date: datetime) -> DataFrame:
    """One row with ``artifact``: the whole record of a run, as JSON with nulls kept.

    ``pool`` are the held-out comments (repo_owner, repo_name); ``tune`` and ``test`` are ``metrics.sample_results``, which the split
    bounds. The floor is that of the highest F1 over ``tune``; the final score of ``test`` takes it and the judge. The parts meet
    as scalar subqueries: the samples alone are gathered, one row of numbers comes from everything else. Without test
    samples the share of those without retrieval is null; empty tables give empty lists.
    """
    named = pool.select(F.concat_ws("/", "repo_owner", "repo_name").alias("repo"))
    sizes = evalsplit.pool_sizes(named, ["repo"])
    entries = F.array_sort(F.collect_list(F.struct("repo", "n_rows")))
    swept = metrics.sweep(tune)
    floor = metrics.best_threshold(swept).first().floor if not tune.isEmpty() else metrics.THRESHOLDS[0]
    final, cold = metrics.final_score(test, floor), metrics.cold_start(test)
    parts = {
        "run_at": F.lit(run_at.isoformat()),
        "split_date": F.lit(split_date.isoformat()),
        "repo_pool": sizes.agg(F.array_sort(F.collect_list("repo"))).scalar(),
        "pool_sizes_by_repo": sizes.agg(F.map_from_entries(entries)).scalar(),
        "tune_size": tune.agg(F.count("*")).scalar(),
        "test_size": test.agg(F.count("*")).scalar(),
        "tuning_sweep": _sorted_list(swept, "threshold", ("threshold", *SCORE_FIELDS)),
        "floor_selected": F.lit(floor),
        "final_metrics": final.select(F.struct("floor", *SCORE_FIELDS)).scalar(),
        "no_retrieval_match_count": cold.select("no_retrieval_match_count").scalar(),
        "no_retrieval_match_pct": cold.select("no_retrieval_match_pct").scalar(),
        "test_sample_results": _sorted_list(test, "sample_id", SAMPLE_FIELDS),
    }
    whole = F.struct(*(part.alias(name) for name, part in parts.items()))
    return pool.sparkSession.range(1).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("artifact"))


def write_record(record: DataFrame, folder: str, run_at: datetime) -> str:
    """Writes the one text of ``record`` under the time of its run, and returns the path; a run that is there already is an error."""
    path = f"{folder}/held_out_eval_{run_at:%Y%m%d_%H%M%S}"
    record.select("artifact").coalesce(1).write.mode("errorifexists").text(path)
    return path
