"""Operator 1: near-duplicate vectors by cosine, inside spherical k-means cells with exact borders."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.arrays import unite
from sparkloom.llm.components import connected_components
from sparkloom.llm.shared import keyed_rows, written


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit rows ``x``; empty cells take the rows that fit worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        score = x @ c.T
        cell = score.argmax(axis=1)
        for d in range(x.shape[1]):
            c[:, d] = np.bincount(cell, weights=x[:, d], minlength=k)
        empty = np.flatnonzero(np.bincount(cell, minlength=k) == 0)
        if len(empty):
            c[empty] = x[np.argsort(score.max(axis=1), kind="stable")[: len(empty)]]
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(norm > 0, c / np.where(norm > 0, norm, 1), x[:1])
    return c


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as double rows, short ones padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _units(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dealt(centroids: np.ndarray, parts: list[int], width: int, threshold: float):
    """Each vector once for its own block and once for every block it may have a partner in.

    y lies in cell j only if y.(c_i - c_j) <= 0 for all i; if cos(x, y) >= t then x.u <= sqrt(1 - t * t) for the unit
    vector u along c_i - c_j. Vectors of cell i that are farther from that border need not visit cell j.
    """
    gap = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    first = np.append(0, np.cumsum(parts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                x = _units(_matrix(some.column(1), width))
                score = x @ centroids.T
                cell = score.argmax(axis=1)
                own = score[np.arange(len(x)), cell]
                visits = (own[:, None] - score) <= reach * gap[cell]
                visits &= np.arange(len(centroids)) >= cell[:, None]
                row_out, block_out, home_out = [], [], []
                for i, (c, n) in enumerate(zip(cell.tolist(), node[k : k + 512].tolist())):
                    sub = (n * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % parts[c]
                    for j in np.flatnonzero(visits[i]).tolist():
                        blocks = range(first[j] + (sub if j == c else 0), first[j + 1])
                        row_out += [i] * len(blocks)
                        block_out += blocks
                        home_out += [j == c and b == first[c] + sub for b in blocks]
                take = pa.array(row_out, pa.int64())
                sent = some.take(take)
                yield pa.RecordBatch.from_arrays([pa.array(block_out, pa.int64()), pa.array(home_out, pa.bool_()), *sent.columns], names=["block", "home", "node", "vector", "times"])

    return rows


def _compared(width: int, threshold: float, chunk: int = 1024):
    """Links of each block's home rows with one another and with its visitors: counts, and a spanning forest."""
    slack = 1e-5

    def links(a: np.ndarray, b: np.ndarray, ad: np.ndarray, bd: np.ndarray, asize: np.ndarray, bsize: np.ndarray) -> np.ndarray:
        rough = a @ b.T
        near = rough >= threshold + slack
        i, j = np.nonzero((rough >= threshold - slack) & ~near)
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            near[p, q] = (ad[p] * bd[q]).sum(axis=1) >= threshold
        if not (asize[0] == asize).all() or not (bsize == asize[0]).all():
            near &= asize[:, None] == bsize[None, :]
        return near

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home = None, None

        def out(node, count, a, b):
            hit = count > 0
            n, m = int(hit.sum()), len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[hit], a])), pa.array(np.concatenate([count[hit], np.zeros(m, np.int64)])), pa.array(np.concatenate([np.zeros(n, np.int64), b])), pa.array(np.append(np.zeros(n, bool), np.ones(m, bool)))],
                names=["a", "links", "b", "edge"],
            )

        def prepared(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            column = t.column("vector").combine_chunks()
            d = _units(_matrix(column, width))
            return t.column("node").to_numpy(), t.column("times").to_numpy(), d.astype(np.float32), d, np.diff(column.offsets.to_numpy())

        def against(home, there, same):
            node_h, times_h, fh, dh, sh = home
            node_v, times_v, fv, dv, sv = there
            n, m = len(node_h), len(node_v)
            parent = np.arange(n if same else n + m)
            count_h, count_v = np.zeros(n, np.int64), np.zeros(m, np.int64)
            for k in range(0, m, chunk):
                near = links(fh, fv[k : k + chunk], dh, dv[k : k + chunk], sh, sv[k : k + chunk])
                if same:
                    near[np.arange(k, min(k + chunk, m)), np.arange(min(chunk, m - k))] = False
                if not near.any():
                    continue
                count_h += (near.astype(np.float64) @ times_v[k : k + chunk]).astype(np.int64)
                if not same:
                    count_v[k : k + chunk] += (times_h @ near.astype(np.float64)).astype(np.int64)
                shift = k if same else n + k
                for r in range(0, n, 256):
                    apart = near[r : r + 256] & (parent[r : min(r + 256, n), None] != parent[None, shift : shift + near.shape[1]])
                    i, j = np.nonzero(apart)
                    unite(parent, i + r, j + shift)
            node = node_h if same else np.concatenate([node_h, node_v])
            count = count_h if same else np.concatenate([count_h, count_v])
            child = np.flatnonzero(parent != np.arange(len(parent)))
            return out(node, count, node[child], node[parent[child]])

        waiting: list[pa.RecordBatch] = []

        def settle():
            nonlocal home, waiting
            if waiting:
                home = prepared(waiting)
                waiting = []
                return against(home, home, True)

        for batch in batches:
            block, is_home = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            code = block * 2 + ~is_home
            edges = np.append(np.flatnonzero(np.diff(code, prepend=code[0] - 1)), batch.num_rows) if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(int(a), int(b - a))
                if block[a] != now:
                    done = settle()
                    if done is not None:
                        yield done
                    now, home = block[a], None
                if is_home[a]:
                    waiting.append(part)
                else:
                    done = settle()
                    if done is not None:
                        yield done
                    if home is not None:
                        yield against(home, prepared([part]), False)
        done = settle()
        if done is not None:
            yield done

    return rows


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block_rows: int = 2048, fit_rows: int = 16384, max_cells: int = 1024) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id reachable), kept (is its representative).

    Two vectors link if their cosine in double precision is ``threshold`` or more (threshold over 0). All pairs that
    can link are compared: equal vectors are one class with a weight; spherical k-means, fitted on the ``fit_rows``
    classes that hash lowest, deals classes to cells; a class also visits the later cells whose border is near enough;
    cells over ``block_rows`` are cut in blocks. float32 products settle clear cases, doubles the rest.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of
    different lengths. Rows that repeat an id and vector link with each other. Null ids are kept; a component's id is
    the smallest non-null one. An empty table gives no rows. Other columns, labels included, are ignored.
    """
    v = F.col(vector_col)
    width = vectors.agg(F.max(F.size(v))).first()[0] or 0
    usable = F.expr(f"coalesce(size({vector_col}) > 0 and forall({vector_col}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({vector_col}, x -> x <> 0), false)")
    rows = keyed_rows(vectors, id_col, vector_col).withColumn("usable", usable)
    same = F.xxhash64("vector").alias("hash")
    good = rows.where("usable").select(id_col, "row_key", F.transform(v, lambda x: x + F.lit(0).cast("float")).alias("vector"))
    classes = written(good.groupBy("vector").agg(F.count("*").alias("times"), F.min(id_col).alias("smallest"), F.min("row_key").alias("node")), "vectors")
    n = classes.count()
    sample = classes.select("vector", same).orderBy("hash").limit(fit_rows).select("vector").toArrow().column("vector").combine_chunks()
    k = max(1, min(max_cells, len(sample) // 8, math.ceil(n / block_rows)))
    if n:
        centroids = spherical_kmeans(_units(_matrix(sample, width)), k)
    else:
        centroids = np.zeros((1, max(1, width)))
    counts = dict(classes.select("vector").mapInArrow(_cells(centroids, width), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()) if n else {}
    parts = [max(1, math.ceil(counts.get(c, 0) / block_rows)) for c in range(len(centroids))]
    element = dict(classes.dtypes)["vector"]
    found = (
        classes.select("node", "vector", "times").mapInArrow(_dealt(centroids, parts, width, threshold), f"block long, home boolean, node long, vector {element}, times long")
        .repartition("block").sortWithinPartitions("block", F.desc("home")).mapInArrow(_compared(width, threshold), "a long, links long, b long, edge boolean")
    )
    found = written(found, "links")
    groups = connected_components(found.where("edge").select("a", "b"))
    per_class = found.where("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = classes.join(per_class, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    names = placed.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_class = placed.join(names, "root").select("vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), "component_id")
    linked = good.join(by_class, "vector").select(F.col(id_col), "n_links", "component_id")
    alone = rows.where("not usable").select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _cells(centroids: np.ndarray, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount((_units(_matrix(batch.column(0), width)) @ centroids.T).argmax(axis=1), minlength=len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids))), pa.array(n)], names=["cell", "n"])

    return rows
