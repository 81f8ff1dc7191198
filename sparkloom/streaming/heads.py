"""Work on a stream, held until no newer head can make it obsolete."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from sparkloom.sinks import keyed

BATCH, HELD = "batch", "held"
_OWN = (BATCH, HELD, "_t", "_work", "_head", "_span", "_back", "_first", "_last", "_other", "_ends", "_next", "_waits")
_MICRO = timedelta(microseconds=1)


def still_current(work: DataFrame, heads: DataFrame, by: list[str], value: str, ts: str, hold: str, watermark: str) -> DataFrame:
    """Rows of ``work`` for whose key no head of another ``value`` comes within ``hold`` after them (``heads`` has by, value and ts).

    A stream-stream join from both sides' watermarks: a row waits until the watermark is past its time by ``hold``, then goes out if
    nothing met it. Both sides' rows are dropped once they can meet nothing more, so between batches the state holds ``hold`` and
    ``watermark``'s worth of events, not their history. Late heads count up to the watermark. Rows with a null key, value or time
    never become obsolete.

    Within a batch all its rows are in the state, and each meets all of its key there. For large batches take ``StillCurrent``.
    """
    later = heads.select(*(F.col(c).alias(f"head_{c}") for c in by), F.col(value).alias("head_value"), F.col(ts).alias("head_ts")).withWatermark("head_ts", watermark)
    met = (F.col("head_ts") > F.col(ts)) & (F.col("head_ts") <= F.col(ts) + F.expr(f"interval {hold}")) & (F.col("head_value") != F.col(value))
    for c in by:
        met &= F.col(c) == F.col(f"head_{c}")
    return work.withWatermark(ts, watermark).join(later, met, "leftOuter").where("head_ts is null").drop("head_ts", "head_value", *(f"head_{c}" for c in by))


@dataclass(frozen=True)
class StillCurrent:
    """``still_current`` as a sink for ``foreachBatch``: a batch is sorted once, by key and time, whatever a key's number of rows.

    ``work`` and ``head`` are SQL conditions; a row may be both. Rows that go out (``rows``), and rows held for the next batch, are written to
    ``folder`` by batch. The watermark is Spark's: ``watermark`` behind the newest work or the newest head, whichever is older, in whole
    milliseconds; later batches' rows up to it are dropped as late. Held are rows after it, and work not yet ``hold`` before it that
    nothing met. A batch reads only what the one before it held, so one that runs again writes the same rows again.

    A key's rows are dealt over tasks by time, in spans of ``spans`` holds; heads less than a hold into a span are in the earlier one too.
    """

    folder: str
    by: tuple[str, ...]
    value: str
    ts: str
    hold: timedelta
    watermark: timedelta
    work: str = "true"
    head: str = "true"
    spans: int = 8

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if taken := [c for c in batch.columns if c.lower() in _OWN]:
            raise ValueError(f"the sink has columns of its own named {', '.join(taken)}")
        spark = batch.sparkSession
        earlier = sorted(n for n in self._batches(spark) if n < batch_id)
        rows = batch
        if earlier and keyed.exists(spark, self._held(earlier[-1])):
            held = spark.read.schema(batch.schema).parquet(self._held(earlier[-1]))
            before = self._passed(held)
            rows = held.unionByName(batch if before is None else batch.where(self._micros > before))
        passed = self._passed(rows)
        judged = self._judged(rows)
        if passed is None:
            kept = judged.withColumn(HELD, F.lit(True))
        else:
            out = F.col("_waits") & (F.col("_t") + self.hold // _MICRO <= passed)
            kept = judged.where(F.col("_waits") | (F.col("_t") >= passed)).withColumn(HELD, ~out)
        kept.select(*batch.columns, HELD).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(HELD).parquet(f"{self.folder}/{BATCH}={batch_id}")
        for n in earlier[:-1]:
            at, files = _at(spark, self._held(n))
            files.delete(at, True)

    def rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """What has gone out so far, of a stream of this schema."""
        if not keyed.exists(spark, self.folder):
            return spark.createDataFrame([], schema)
        whole = StructType([*schema.fields]).add(BATCH, "long").add(HELD, "boolean")
        return spark.read.schema(whole).parquet(self.folder).where(f"not {HELD}").drop(BATCH, HELD)

    @property
    def _micros(self):
        return F.unix_micros(F.col(self.ts).cast("timestamp"))

    def _held(self, n: int) -> str:
        return f"{self.folder}/{BATCH}={n}/{HELD}=true"

    def _batches(self, spark: SparkSession) -> Iterator[int]:
        at, files = _at(spark, self.folder)
        for found in files.listStatus(at) if files.exists(at) else []:
            name, _, n = found.getPath().getName().partition("=")
            if name == BATCH:
                yield int(n)

    def _passed(self, rows: DataFrame) -> int | None:
        """The watermark in microseconds; none until there are both work and heads."""
        newest = tuple(rows.agg(*(F.max(F.when(F.expr(c), self._micros)) for c in (self.work, self.head))).first())
        return None if None in newest else (min(newest) // 1000 - self.watermark // timedelta(milliseconds=1)) * 1000

    def _judged(self, rows: DataFrame) -> DataFrame:
        """Work and heads that have a time, with _t, their time in microseconds, and _waits: it is work that no head has met."""
        hold, span, t = self.hold // _MICRO, self.hold // _MICRO * self.spans, F.col("_t")
        is_work, is_head = (F.coalesce(F.expr(c), F.lit(False)) for c in (self.work, self.head))
        has_key = F.expr(" and ".join(f"`{c}` is not null" for c in self.by))
        start, into = t - F.pmod(t, F.lit(span)), F.pmod(t, F.lit(span))
        in_spans = F.when(~has_key, F.array(t)).when(F.col("_head") & (into < hold), F.array(start, start - span)).otherwise(F.array(start))
        rows = rows.where(is_work | is_head).select("*", self._micros.alias("_t"), is_work.alias("_work"), (is_head & has_key & F.col(self.value).isNotNull()).alias("_head")).where("_t is not null")
        rows = rows.withColumn("_span", F.explode(in_spans)).withColumn("_back", -t)
        # The newest first, and frames that only grow: each row is added to them once.
        later = Window.partitionBy(*self.by, "_span").orderBy("_back").rangeBetween(Window.unboundedPreceding, -1)
        value, first, last = F.col(self.value), F.col("_first"), F.col("_last")
        rows = rows.withColumns({"_first": F.min(F.when(F.col("_head"), F.struct("_t", value.alias("v")))).over(later), "_last": F.max(F.when(F.col("_head"), F.struct("_back", value.alias("v")))).over(later)})
        # _first and _last: the least and the greatest value of the next time that has heads. If both are the row's own, what ends that
        # run of one value is the first of the later heads whose own next time has another.
        rows = rows.withColumn("_other", (first.v != value) | (last.v != value)).withColumn("_ends", F.when(F.col("_head") & F.col("_other"), first["_t"]))
        rows = rows.withColumn("_next", F.when(F.col("_other"), first["_t"]).otherwise(F.min("_ends").over(later)))
        met = F.coalesce(value.isNotNull() & (F.col("_next") <= t + hold), F.lit(False))
        return rows.where(F.col("_span") >= start).withColumn("_waits", F.col("_work") & ~met)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())
