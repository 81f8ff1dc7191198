"""Reports delivered to a live service once a head, found again by their hidden mark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RETRIED = (429, 500, 502, 503, 504)


def mark_of(body: Column) -> Column:
    """The hidden mark a report begins with (see ``report.marked``); null without one."""
    return F.nullif(F.regexp_extract(body, r"^<!-- review:(\S+) -->", 1), F.lit(""))


class Refused(Exception):
    """A service's answer that is no success: its status, and seconds to wait if it names them."""

    def __init__(self, status: int, retry_after: float | None = None, spent: bool = False):
        super().__init__(f"status {status}")
        self.status, self.retry_after, self.spent = status, retry_after, spent


def deliver_one(service, place: str, mark: str | None, body: str, retries: int, longest: float, sleep: Callable[[float], None]) -> tuple[str | None, str, int, str | None]:
    """(id, action, attempts, error). Each attempt looks for the mark first, so an answer that was lost on its way is found, not posted twice."""
    for attempt in range(retries + 1):
        try:
            known = service.find(place, mark) if mark else None
            if known is not None:
                service.update(place, known, body)
                return str(known), "updated", attempt + 1, None
            return str(service.create(place, body)), "created", attempt + 1, None
        except (Refused, ConnectionError, TimeoutError) as problem:
            lasting = isinstance(problem, Refused) and problem.status not in RETRIED and not (problem.status == 403 and problem.spent)
            asked = getattr(problem, "retry_after", None)
            if lasting or attempt == retries or asked is not None and asked > longest:
                return None, "failed", attempt + 1, f"{type(problem).__name__}: {problem}"
            sleep(min(longest, asked if asked is not None else 2.0**attempt))
    raise ValueError("retries is negative")


def delivered(reports: DataFrame, service, key: str = "review_id", place: str = "place", retries: int = 3, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """What became of each of ``reports`` (key, place, body): comment_id, action (updated, created, failed), attempts, error.

    ``service`` has find(place, mark), update(place, id, body) and create(place, body); they raise ``Refused`` or a connection error.
    Reports of one mark and place meet in one task, the last by key wins, so two do not race; a task that runs again updates
    what it posted before. A failure is data. Write the rows once (``keyed.upsert``): reading them twice delivers twice.
    """
    kind = dict(reports.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *deliver_one(service, p, m, b, retries, longest, sleep)) for k, p, m, b in zip(*(c.to_pylist() for c in batch.columns))]
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, "comment_id", "action", "attempts", "error"])

    mark = mark_of(F.col("body"))
    alone = F.when(mark.isNull(), F.col(key).cast("string"))
    last = reports.groupBy(F.col(place).alias("place"), mark.alias("mark"), alone.alias("alone")).agg(F.max(F.struct(key, "body")).alias("r"))
    return last.select(F.col("r")[key].alias(key), "place", "mark", F.col("r")["body"].alias("body")).mapInArrow(run, f"{key} {kind}, comment_id string, action string, attempts long, error string")
