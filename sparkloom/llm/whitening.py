"""Operator 13: embedding whitening from exact integer sums and a covariance of two passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.arrays import sliced
from sparkloom.llm.shared import written

LONG = 2**63 - 1


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """id and x, the vector in whole steps of 1/scale from -shift on; only rows whose vector has entries that are all finite and in a long's reach."""
    reach = 2.0**62 / scale
    usable = F.expr(f"coalesce(size({vector_col}) > 0 and forall({vector_col}, c -> c is not null and not isnan(c) and abs(c) < {reach!r}D), false)")
    steps = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))
    return vectors.where(usable).select(F.col(id_col).alias("id"), steps.alias("x"))


def _rows_at_once(width: int) -> int:
    return max(16, (1 << 22) // (8 * width))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(width: int):
    """Per dimension: rows, sum, least and greatest entry of a partition, without rounding."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * width, None, None
        for part in sliced(batches, _rows_at_once(width)):
            x = _matrix(part.column(0), width)
            a, b = x.min(axis=0), x.max(axis=0)
            wide = max(-int(a.min()), int(b.max())) > LONG // len(x)
            total = [t + int(s) for t, s in zip(total, x.astype(object).sum(axis=0) if wide else x.sum(axis=0))]
            n, low, high = n + len(x), a if low is None else np.minimum(low, a), b if high is None else np.maximum(high, b)
        if n:
            sums = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), sums, pa.array(low), pa.array(high)], names=["dim", "n", "total", "low", "high"])

    return rows


def _products(width: int, seen: Callable[[np.ndarray], np.ndarray]):
    """The sum of the outer products of ``seen(x)`` over a partition and, as a last row, its sum."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in sliced(batches, _rows_at_once(width)):
            y = seen(_matrix(part.column(0), width))
            both = np.vstack([y.T @ y, y.sum(axis=0)])
            total = both if total is None else total + both
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return rows


def _merged(fit: DataFrame, width: int, wide: int, seen: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``_products`` of all partitions, merged as a tree: the driver gets a few matrices, however many partitions there are."""
    parts = fit.select("x").mapInArrow(_products(width, seen), "total binary").rdd
    total = parts.treeAggregate(None, lambda a, r: _added(a, r.total), _added, depth=3)
    return np.frombuffer(total).reshape(wide + 1, wide)


def _added(a: bytes | None, b: bytes | None) -> bytes | None:
    if a is None or b is None:
        return a if b is None else bytes(b)
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def _centred(whole: np.ndarray, part: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: (x - whole).astype(np.float64) - part


def _projected(width: int, n: int, sums: list[int], fits: bool, whole: np.ndarray, part: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    """Each row once per component."""
    k, centred = axes.shape[1], _centred(whole, part)
    rest = np.array([s - n * int(w) for s, w in zip(sums, whole)], np.int64 if fits else object)  # n * x - S = n * (x - whole) - rest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in sliced(batches, min(1024, _rows_at_once(width))):
            x = _matrix(some.column(1), width)
            if fits:
                far = n * (x - whole) - rest
                deviation = pa.array((far * far).sum(axis=1).repeat(k))
            else:
                far = n * (x.astype(object) - whole.astype(object)) - rest
                exact = [Decimal(int(v)) if v < 10**38 else None for v in (far * far).sum(axis=1)]
                deviation = pa.array(np.repeat(np.array(exact, object), k).tolist(), pa.decimal128(38, 0))
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0).take(pa.array(np.arange(m).repeat(k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation,
                    pa.array((centred(x) @ axes).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """Per usable row and component up to ``components``: id, component, n, deviation, whitened, explained, identity_error.

    A vector becomes integers x = floor(scale * c) + shift. Each distinct x counts once (the fit list): an aggregation finds
    them, so a vector that fills a third of all rows is one row before the shuffle. The first pass sums them in whole
    numbers (S); the second sums outer products of x - S/n by GEMM a partition, merged as a tree; LAPACK gives the eigenvectors of the
    covariance V, numbered by falling eigenvalue, their largest entry positive. A third pass measures identity_error, the
    largest absolute entry of the whitened fit list's covariance minus the identity. whitened is x - S/n on the component over the
    root of its eigenvalue, explained the eigenvalue's share of V's trace; deviation is the exact sum of (n * x - S)^2, a
    long if all fit, else decimal(38,0) (null beyond 38 digits).

    Memory: width squared doubles in a task and a few times that in the driver, whatever the number of rows.

    Rows without a usable vector go: null, empty, or with entries that are null, not finite or beyond 2^62 steps. So do
    vectors of another length than most rows have (ties: the longer). Eigenvalues within rounding error of zero (1,000 *
    width * epsilon of the largest) have no whitened component and are left out: with fewer different vectors than
    components there are fewer rows, and with one vector or an empty table none. Null and repeated ids are kept; other
    columns are ignored.
    """
    kind = dict(vectors.dtypes)[id_col]
    out = f"id {kind}, component int, n long, deviation {{}}, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors, id_col, vector_col, scale, shift)
    usual = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    named = lambda df: df.withColumnRenamed("id", id_col)
    empty = named(vectors.sparkSession.createDataFrame([], out.format("long")))
    if usual is None:
        return empty
    width = usual.width
    rows = rows.where(F.size("x") == width)
    fit = written(rows.select("x").distinct(), "fitlist")
    stats = fit.mapInArrow(_summed(width), "dim long, n long, total decimal(38,0), low long, high long").groupBy("dim").agg(F.sum("n"), F.sum("total"), F.min("low"), F.max("high")).orderBy("dim").collect()
    n, sums = int(stats[0][1]), [int(s[2]) for s in stats]
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n / n for s in sums])
    furthest = max(max(abs(n * int(v) - s) for v in r[3:5]) for r, s in zip(stats, sums))
    fits = width * furthest * furthest <= LONG and n * max(int(r[4]) - int(r[3]) + 1 for r in stats) <= LONG
    v = _merged(fit, width, width, _centred(whole, part))[:width] / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    keep = min(components, int((values > 1000 * width * np.finfo(float).eps * max(values[0], 0)).sum()))
    if not keep:
        return empty
    top = axes[:, :keep]
    top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(keep)] < 0, -1, 1) / np.sqrt(values[:keep])
    centred = _centred(whole, part)
    w = _merged(fit, width, keep, lambda x: centred(x) @ top) / n
    error = float(np.abs(w[:keep] - np.outer(w[keep], w[keep]) - np.eye(keep)).max())
    job = _projected(width, n, sums, fits, whole, part, top, values[:keep] / np.trace(v), error)
    return named(rows.mapInArrow(job, out.format("long" if fits else "decimal(38,0)")))
