"""Reading tables, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

_own_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own in local mode; on a cluster an error, as a
    machine's own folder would lose what other machines write."""
    global _own_root
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _own_root


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Later reads do not depend on the executors that computed it. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sparkloom-{uuid.uuid4().hex}-{tag}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """True if the ids are integers, present and unique: one small aggregation over that column alone."""
    if dict(df.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    counts = df.groupBy(F.col(id_col).alias("id")).count()
    return not counts.where("count > 1 or id is null").limit(1).count()


def keyed_rows(df: DataFrame, id_col: str, *cols: str, key: str = "row_key", extra: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a long ``key`` that tells its rows apart, and only ``id_col``, ``cols`` and ``extra`` besides.

    The key is the id itself if ids are unique; else a hash of the id and ``cols``, so that rows with one key are
    exact repeats in these and share every verdict. A second hash checks that; the seed changes until no two
    different rows share a key.
    """
    rows = df.select(id_col, *cols, *extra)
    if unique_ids(df, id_col):
        return rows.withColumn(key, F.col(id_col).cast("long"))
    for seed in range(8):
        hashed = F.xxhash64(F.lit(seed), F.struct(id_col, *cols))
        other = F.xxhash64(F.lit(-1 - seed), F.struct(id_col, *cols))
        clash = df.select(hashed.alias("h"), other.alias("o")).groupBy("h").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a <> b")
        if clash.isEmpty():
            return rows.withColumn(key, hashed)
    raise RuntimeError(f"no 64-bit hash tells all rows apart: give unique integers in {id_col}")


def memory_bytes(df: DataFrame) -> int:
    """The bytes the rows of ``df`` take when broadcast, by one aggregation over their values: eight for each number, flag
    and offset, and the bytes of strings."""

    def size(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.lit(16) + F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, StructType):
            return sum((size(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        if isinstance(kind, ArrayType):
            inner = kind.elementType
            if fixed(inner):
                return F.lit(24) + F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)) * fixed(inner)
            return F.lit(24) + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + size(x, inner)), F.lit(0))
        return F.lit(8)

    def fixed(kind: DataType) -> int:
        if isinstance(kind, StructType):
            parts = [fixed(f.dataType) for f in kind.fields]
            return 16 + sum(parts) if all(parts) else 0
        return 0 if isinstance(kind, (StringType, BinaryType, ArrayType)) else 8

    row = sum((size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32))
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if its rows, just written and cheap to count, take at most ``most`` bytes."""
    return F.broadcast(df) if memory_bytes(df) <= most else df
