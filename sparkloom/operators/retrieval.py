"""Similar past comments: threshold join, top-k, re-ranking and repeated bodies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import paths, text

SIMILARITY = 0.55
RESULTS = 5
OVERFETCH = 4
MIN_HUNK = 30
BONUS = {"identifier": 0.08, "suffix": 0.025, "test": 0.025, "repo": 0.02}


SLACK = 1e-9  # over what rounding does to a cosine
FOUND = "query_id long, id long, similarity double"


def vector_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of ``a`` with that of ``b``, summed in order: the same bits wherever two rows lie."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def best_rows(queries: pa.Table, corpus: pa.RecordBatch | pa.Table, width: int, threshold: float, limit: int, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    """The ``limit`` best corpus rows for each query out of every 4,096.

    Matrix products of bounded size propose them; as their last bits depend on where a row lies, the similarity of those is computed
    pair by pair, so that equal vectors tie and the lower id comes first."""
    ids, wanted = queries.column("query_id").to_numpy(), vector_rows(queries.column("vector"), width)
    before = queries.column("before").to_numpy() if "before" in queries.column_names else None
    length = np.sqrt(dots(wanted, wanted))
    unit = wanted / np.where(length > 0, length, 1)[:, None]
    for k in range(0, corpus.num_rows, 4096):
        some = corpus.slice(k, 4096)
        x, own = vector_rows(some.column("vector"), width), some.column("id").to_numpy()
        at = None if before is None else some.column("at").to_numpy()
        norm = np.sqrt(dots(x, x))
        other = np.where(norm > 0, x.T, 0) / np.where(norm > 0, norm, 1)
        for j in range(0, len(ids), 256):
            asked = slice(j, j + 256)
            score = unit[asked] @ other
            fits = score >= threshold - SLACK
            if before is not None:
                fits &= at[None] < before[asked, None]
            if exclude_self:
                fits &= ids[asked, None] != own[None]
            if score.shape[1] > limit:
                score[~fits] = -np.inf
                last = score.shape[1] - limit
                fits &= score >= np.partition(score, last, axis=1)[:, last : last + 1] - SLACK
            q, c = np.nonzero(fits)
            q += j
            size = length[q] * norm[c]
            inner = [dots(wanted[q[h : h + 16384]], x[c[h : h + 16384]]) for h in range(0, len(q), 16384)]
            exact = np.where(size > 0, np.concatenate([[], *inner]) / np.where(size > 0, size, 1), 0.0)
            best = np.lexsort((own[c], -exact, q))
            nth = np.arange(len(q)) - np.searchsorted(q[best], q[best])
            best = best[(nth < limit) & (exact[best] >= threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[best]]), pa.array(own[c[best]]), pa.array(exact[best])], names=["query_id", "id", "similarity"])


def top_similar(queries: DataFrame, corpus: DataFrame, limit: int, threshold: float = -1.0, exclude_self: bool = False, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, id, similarity, nth): for each of ``queries`` (query_id, vector) the best of ``corpus`` (id, vector).

    With columns ``before`` (queries) and ``at`` (corpus), both long, only rows with at < before count for a query.
    Exact cosine in double. Queries that fit in ``block_bytes`` go to every task, and the corpus is not shuffled. More are
    dealt to blocks of about that size, as is the corpus, and each pair of blocks is a group of its own: the driver holds
    neither. Only each 4,096 rows' best are shuffled for the ranking. Vectors that are null, hold nulls or have another
    length than the queries match nothing; queries of different lengths are an error. Ties go to the lower id.
    """
    timed = "before" in queries.columns
    there = "vector is not null and not exists(vector, x -> x is null)"
    queries = queries.where(f"{there} and size(vector) > 0").select("query_id", "vector", *(["before"] if timed else []))
    least, width, n = queries.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count("*")).first()
    if not n:
        return corpus.sparkSession.createDataFrame([], f"{FOUND}, nth int")
    if least != width:
        raise ValueError(f"query vectors have {least} to {width} components")
    corpus = corpus.where(f"{there} and size(vector) = {width}" + (" and at is not null" if timed else "")).select("id", "vector", *(["at"] if timed else []))
    blocks = -(-n * 8 * width // block_bytes)
    if blocks == 1:
        asked = queries.toArrow()

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from best_rows(asked, batch, width, threshold, limit, exclude_self)

        found = corpus.mapInArrow(beside, FOUND)
    else:
        parts = max(1, -(-corpus.count() * 8 * width // block_bytes))
        dealt = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = queries.withColumn("q_block", dealt("query_id", blocks)).withColumn("c_block", every(parts))
        right = corpus.withColumn("c_block", dealt("id", parts)).withColumn("q_block", every(blocks))

        def cell(asked: pa.Table, some: pa.Table) -> pa.Table:
            return pa.Table.from_batches(best_rows(asked, some, width, threshold, limit, exclude_self), pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())]))

        found = left.groupBy("q_block", "c_block").cogroup(right.groupBy("q_block", "c_block")).applyInArrow(cell, FOUND)
    return ranked_rows(found, limit)


def ranked_rows(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def rank_score(similarity: Column, hunk: Column, target_path: Column, past_hunk: Column, past_body: Column, past_path: Column, same_repo: Column) -> Column:
    """Similarity rounded to three digits, with small bonuses for shared identifiers, suffix, tests and repository."""
    past = text.identifiers(F.concat(F.coalesce(past_hunk, F.lit("")), F.lit("\n"), F.coalesce(past_body, F.lit(""))))
    own = paths.suffix(target_path)
    bonus = lambda c, name: F.when(F.coalesce(c, F.lit(False)), BONUS[name]).otherwise(0.0)
    return (
        F.round(F.coalesce(similarity, F.lit(0.0)), 3) + bonus(F.arrays_overlap(text.identifiers(hunk), past), "identifier")
        + bonus((own != "") & (own == paths.suffix(past_path)), "suffix") + bonus(paths.is_test_path(target_path) & paths.is_test_path(past_path), "test") + bonus(same_repo, "repo")
    )


def first_of_each_body(hits: DataFrame, body: str, order: list[Column], by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first row in ``order`` of each body (ignoring case and white space at the ends), within ``by``."""
    w = Window.partitionBy(*by, text.body_key(F.col(body))).orderBy(*order)
    return hits.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def first_ids(rows: DataFrame, body: str, id_col: str) -> DataFrame:
    """The lowest id of each body, the same way, over a whole corpus: digests are shuffled, texts are not."""
    return rows.groupBy(F.sha2(text.body_key(F.col(body)), 256).alias("__body")).agg(F.min(id_col).alias(id_col)).drop("__body")


def long_enough(hunk: Column) -> Column:
    return F.length(text.strip(F.coalesce(hunk, F.lit("")))) >= MIN_HUNK


def similar_comments(hunks: DataFrame, corpus: DataFrame, limit: int = RESULTS, threshold: float = SIMILARITY, index: str | None = None) -> DataFrame:
    """Live retrieval for ``hunks`` (query_id, hunk, path, repo_owner, repo_name, vector) over review comments.

    Candidates over the threshold (four times ``limit`` by similarity) are re-ranked, repeated bodies go, and the first
    ``limit`` stay: columns of the comment with similarity, score and nth. Candidates are exact; with ``index``, the
    path of a stored index of the corpus by github_comment_id, they are those it finds.
    """
    fit = hunks.where(long_enough(F.col("hunk")))
    if index:
        from sparkloom.operators.vector_index import search_index

        near = search_index(corpus.sparkSession, index, fit, OVERFETCH * limit, threshold)
    else:
        near = top_similar(fit, corpus.select(F.col("github_comment_id").alias("id"), F.col("embedding").alias("vector")), OVERFETCH * limit, threshold)
    asked = fit.select("query_id", F.col("hunk").alias("target_hunk"), F.col("path").alias("target_path"), F.col("repo_owner").alias("target_owner"), F.col("repo_name").alias("target_name"))
    hits = near.drop("nth").join(corpus.drop("embedding"), F.col("id") == F.col("github_comment_id")).join(asked, "query_id")
    same = (F.col("target_owner") == F.col("repo_owner")) & (F.col("target_name") == F.col("repo_name"))
    score = rank_score(F.col("similarity"), F.col("target_hunk"), F.col("target_path"), F.col("diff_hunk"), F.col("body"), F.col("path"), same)
    order = [F.desc("score"), F.desc("similarity"), F.asc("id")]
    ranked = first_of_each_body(hits.withColumn("score", score), "body", order)
    out = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("nth") <= limit)
    return out.withColumn("similarity", F.round("similarity", 3)).drop("id")


def similar_comments_for_eval(samples: DataFrame, corpus: DataFrame, pool: DataFrame, limit: int = RESULTS, threshold: float = SIMILARITY) -> DataFrame:
    """Retrieval for held-out ``samples`` (query_id, hunk, before_date, vector): no hit may be as late as the cut-off.

    The corpus is cut to ``pool`` (repo_owner, repo_name). The first ``limit`` by similarity stay, then repeated bodies
    go, so there may be fewer. One pass over the corpus, whatever the cut-offs.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    mine = corpus.join(pool.select("repo_owner", "repo_name").distinct(), ["repo_owner", "repo_name"], "left_semi")
    asked = samples.where(long_enough(F.col("hunk"))).withColumn("before", micros("before_date"))
    near = top_similar(asked, mine.select(F.col("github_comment_id").alias("id"), F.col("embedding").alias("vector"), micros("comment_created_at").alias("at")), limit, threshold)
    hits = near.join(mine.drop("embedding"), F.col("id") == F.col("github_comment_id")).drop("id")
    return first_of_each_body(hits, "body", [F.asc("nth")]).withColumn("similarity", F.round("similarity", 3))
