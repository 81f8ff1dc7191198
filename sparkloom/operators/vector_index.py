"""A stored index for approximate vector search: cells between hyperplanes, of which a query visits those nearest to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.operators.retrieval import FOUND, best_rows, ranked_rows, top_similar, vector_rows

USABLE = "vector is not null and size(vector) > 0 and not exists(vector, x -> x is null)"
MOST_BITS = 16
SAMPLE_BYTES, SAMPLE_ROWS = 32 << 20, 16384
CELL = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


def margins(x: np.ndarray, planes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed distances of the directions of ``x`` from each hyperplane; a zero vector lies where the offsets put it."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1) @ planes.T - offsets


def cell_numbers(far: np.ndarray) -> np.ndarray:
    return ((far > 0) << np.arange(far.shape[1])).sum(axis=1)


def cell_order(far: np.ndarray) -> np.ndarray:
    """All cells for one query, nearest first: a cell costs the squared distances of the planes in between."""
    costs = np.zeros(1)
    for d in far**2:
        costs = np.concatenate([costs, costs + d])
    return np.argsort(costs, kind="stable") ^ int(cell_numbers(far[None])[0])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _cell(vector: Column, planes: np.ndarray, offsets: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cell_numbers(margins(_matrix(v), planes, offsets)).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    return cell(vector)


def _nearest_cells(vector: Column, planes: np.ndarray, offsets: np.ndarray, probes: int) -> Column:
    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series([cell_order(m)[:probes].astype("int32") for m in margins(_matrix(v), planes, offsets)] if len(v) else [], dtype=object)

    return nearest(vector)


def build_index(corpus: DataFrame, path: str, recall: float = 0.95, limit: int = 20, cell_rows: int = 1024, part_rows: int = 32768, trials: int = 256, seed: int = 7) -> None:
    """Writes ``corpus`` (id, vector, optionally at) to ``path`` by cell, and beside it what a search needs to know.

    Hyperplanes have random directions, at right angles to each other, and halve a sample: the rows whose ids hash lowest, at most 16,384
    and 32 MB, which alone go to the driver. Every row is indexed. There are as many planes as leave about ``cell_rows`` rows a
    cell, 16 at most; a cell of over ``part_rows`` is dealt to parts. How many cells a search visits is measured, not guessed: for
    ``trials`` rows of the sample the ``limit`` nearest of the whole corpus are found exactly, and enough cells are
    visited to hold the share ``recall`` of these. On vectors without structure that can be most cells.
    Vectors that are null, hold nulls or are shorter or longer than the commonest length are not indexed, as they match nothing.
    An empty corpus gives an index that finds nothing.
    """
    spark = corpus.sparkSession
    usable = corpus.where(USABLE)
    sizes = usable.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = (sizes.width, sizes["count"]) if sizes else (1, 0)
    rows = usable.where(F.size("vector") == width).withColumn("vector", F.col("vector").cast("array<double>"))
    bits = int(np.clip(np.ceil(np.log2(max(1, n) / cell_rows)), 1, MOST_BITS))
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vector").toArrow()
    sample = vector_rows(drawn.column("vector"), width) if drawn.num_rows else np.zeros((1, width))
    fine = np.isfinite(sample).all(axis=1)
    directions = np.random.default_rng(seed).standard_normal((bits, width))
    planes = np.linalg.qr(directions.T)[0].T if bits <= width else directions / np.linalg.norm(directions, axis=1, keepdims=True)
    offsets = np.median(margins(sample[fine], planes, np.zeros(bits)), axis=0) if fine.any() else np.zeros(bits)
    placed = rows.withColumn("cell", _cell(F.col("vector"), planes, offsets))
    parts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")))  # a row a cell: 65,536 at most
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{path}/rows")

    probes, held = 1 << bits, 1.0
    asked = drawn.filter(pa.array(fine)).slice(0, trials).rename_columns(["query_id", "vector"]) if drawn.num_rows else drawn
    if asked.num_rows:
        stored = spark.read.parquet(f"{path}/rows").select("id", "vector", "cell")
        near = top_similar(spark.createDataFrame(asked), stored, limit, exclude_self=True)
        cells = near.select("query_id", "id").join(stored.select("id", "cell"), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).collect()
        far = dict(zip(asked.column("query_id").to_pylist(), margins(vector_rows(asked.column("vector"), width), planes, offsets)))
        places = np.sort(np.concatenate([np.argsort(cell_order(far[r.query_id]))[r.cells] for r in cells])) if cells else np.zeros(1, int)
        probes = int(places[int(np.ceil(recall * len(places))) - 1]) + 1
        held = float((places < probes).mean())
    about = [(width, n, bits, probes, held, planes.tolist(), offsets.tolist())]
    spark.createDataFrame(about, "width int, n long, bits int, probes int, held double, planes array<array<double>>, offsets array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def search_index(spark: SparkSession, path: str, queries: DataFrame, limit: int, threshold: float = -1.0, exclude_self: bool = False, probes: int | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, id, similarity, nth) as ``top_similar`` gives them, but out of the cells nearest to each query alone.

    Similarities are exact; rows of other cells are missed. ``probes`` is the number of cells a query visits, else that measured when
    the index was built. Queries that fit in ``block_bytes`` with their cells go to the tasks, which read the stored cells in place, only
    those that any query visits, and nothing but the best rows is shuffled. More queries meet the parts of their cells by a shuffle, in
    blocks. With ``before`` (queries) and ``at`` (index), only rows with at < before count.
    """
    about = spark.read.parquet(f"{path}/about").first()
    planes, offsets, width = np.array(about.planes), np.array(about.offsets), about.width
    visits = min(probes or about.probes, 1 << about.bits)
    timed = "before" in queries.columns
    asked = queries.where(f"{USABLE} and size(vector) = {width}").select("query_id", F.col("vector").cast("array<double>").alias("vector"), *(["before"] if timed else []))
    asked = asked.withColumn("cells", _nearest_cells(F.col("vector"), planes, offsets, visits))
    stored = spark.read.parquet(f"{path}/rows").select("id", "vector", "cell", "part", *(["at"] if timed else []))
    stored = stored.where("at is not null") if timed else stored
    blocks = max(1, -(-asked.count() * (8 * width + 4 * visits) // block_bytes))
    if blocks == 1:
        table = asked.toArrow()
        if not table.num_rows:
            return spark.createDataFrame([], f"{FOUND}, nth int")
        visited: dict[int, list[int]] = {}
        for k, cells in enumerate(table.column("cells").to_pylist()):
            for c in cells:
                visited.setdefault(c, []).append(k)
        plain = table.drop_columns(["cells"])
        if len(visited) <= 1000 and len(visited) < 1 << about.bits:
            stored = stored.where(F.col("cell").isin(sorted(visited)))

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                for c in np.unique(cells).tolist():
                    if c in visited:
                        yield from best_rows(plain.take(visited[c]), batch.filter(pa.array(cells == c)), width, threshold, limit, exclude_self)

        found = stored.mapInArrow(beside, FOUND)
    else:
        spread = stored.groupBy("cell").agg((F.max("part") + 1).alias("parts"))
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("cell", F.explode("cells")).drop("cells")
        left = dealt.join(F.broadcast(spread), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def meet(some: pa.Table, held: pa.Table) -> pa.Table:
            return pa.Table.from_batches(best_rows(some, held, width, threshold, limit, exclude_self), CELL)

        by = ("cell", "part", "block")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, FOUND)
    return ranked_rows(found, limit)
