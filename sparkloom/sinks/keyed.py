"""Keyed Parquet tables in hash buckets: a batch replaces only the buckets in which it changes a row.

The same batch twice leaves the same rows, so a writer that failed may simply run again, and so may a stream's batch. One
writer at a time: two that touch one bucket at once would lose one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKET = "bucket"


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The table's rows with their bucket. One that is not there yet has no rows, and the columns of ``like``."""
    if like is not None and not exists(spark, path):
        return like.withColumn(BUCKET, F.lit(0)).limit(0)
    return spark.read.parquet(path)


def one_a_key(batch: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """A row of each key of ``batch``: the first by ``order``, then by its values, so always the same one. Null keys have none."""
    rest = [c for c in batch.columns if c not in key]
    there = batch.where(" and ".join(f"`{c}` is not null" for c in key))
    if not rest:
        return there.distinct()
    sortable = [F.col(c) for c in rest if "map<" not in dict(batch.dtypes)[c]]
    first = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or [])], *sortable))
    return there.groupBy(*key).agg(first.alias("row")).select(*key, *(F.col("row")[c].alias(c) for c in rest)).select(*batch.columns)


def merged(batch: DataFrame, existing: DataFrame, key: list[str], how: str, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``batch`` (one a key) as the table has to hold them, with bucket and change: "insert", "update" or null for none.

    how: "absent" only adds keys that are new. "replace" also gives known keys their new values, but for the columns ``keep``, which stay.
    "fill" adds none; it gives known keys values where they have null.
    """
    values = [c for c in batch.columns if c not in key]
    old = existing.select(BUCKET, *key, F.struct(*values).alias("old"), F.lit(True).alias("known"))
    both = batch.withColumn(BUCKET, bucket_of(key, buckets)).join(old, [BUCKET, *key], "left")
    known, now, before = F.coalesce("known", F.lit(False)), {}, {c: F.col("old")[c] for c in values}
    for c in values:
        if how == "fill":
            now[c] = F.coalesce(before[c], F.col(c))
        elif how == "replace":
            now[c] = F.when(known, before[c]).otherwise(F.col(c)) if c in keep else F.col(c)
        elif how == "absent":
            now[c] = F.col(c)
        else:
            raise ValueError(how)
    differs = F.lit(False)
    for c in values:
        differs = differs | ~now[c].eqNullSafe(before[c])
    change = F.when(~known, F.lit(None if how == "fill" else "insert")).when(differs if how != "absent" else F.lit(False), "update")
    return both.select(BUCKET, *key, *(now[c].alias(c) for c in values), change.alias("change"))


def upsert(batch: DataFrame, path: str, key: list[str], how: str = "absent", buckets: int = 64, keep: tuple[str, ...] = (), order: list[Column] | None = None) -> dict[str, int]:
    """Merges ``batch`` into the table at ``path`` and tells what it did: inserted, updated, skipped (rows that changed nothing).

    Spark reads and replaces only the buckets with a change (dynamic partition overwrite); the driver gets one row of counts a
    bucket. ``buckets`` is the table's for good: take it so that a bucket is a few hundred megabytes at the size the table will
    have. A batch is computed twice; if a provider's answers are in it, checkpoint it first. Rows with a null key are skipped.
    """
    if BUCKET in batch.columns:
        raise ValueError(f"the column {BUCKET} is the table's own")
    spark = batch.sparkSession
    existing = stored(spark, path, batch)
    rows = merged(one_a_key(batch, key, order), existing, key, how, buckets, keep)
    counts = rows.groupBy(BUCKET).agg(F.count_if(F.col("change") == "insert").alias("inserted"), F.count_if(F.col("change") == "update").alias("updated")).where("inserted + updated > 0").collect()
    inserted, updated = sum(r.inserted for r in counts), sum(r.updated for r in counts)
    skipped = batch.count() - inserted - updated  # before the write: the batch may be made of the table itself
    if counts:
        touched = [r[BUCKET] for r in counts]
        changed = rows.where(F.col("change").isNotNull() & F.col(BUCKET).isin(touched)).drop("change")
        rest = existing.where(F.col(BUCKET).isin(touched)).join(changed.select(BUCKET, *key), [BUCKET, *key], "left_anti")
        whole = rest.select(*changed.columns).unionByName(changed)
        whole.repartition(min(len(touched), buckets), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return {"inserted": inserted, "updated": updated, "skipped": skipped}
