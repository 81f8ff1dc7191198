"""Running streams over what there is, and where they keep their state."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_own_folder: str | None = None


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state with timers needs: memory does not grow with the keys."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset, one of our own in local mode; on a cluster an error."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        _own_folder = _own_folder or "file://" + tempfile.mkdtemp(prefix="sparkloom-streams-")
        found = _own_folder
    path = f"{found.rstrip('/')}/sparkloom-{uuid.uuid4().hex}-{tag}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored_once(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and not again if an executor is lost."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, tag: str, sink: Callable | None = None) -> DataFrame | None:
    """Runs ``stream`` over all there is now, then stops. Its rows, from files in the shared folder; none with a ``sink``, a
    function of (batch, batch id) that takes them."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, tag)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    with rocksdb(spark):
        running = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{path}/rows").start()
        running.awaitTermination()
    return None if sink else spark.read.schema(stream.schema).parquet(f"{path}/rows")
