"""Operator 10: sampling to target weights, by iterative proportional fitting over source, language and topic."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.arrays import sliced
from sparkloom.llm.embeddings import spherical_kmeans
from sparkloom.llm.shared import keyed_rows, written

NONE = "(none)"
ROUNDS, CLOSE = 500, 1e-9  # of raking, in the driver and in Spark alike


def stalled(errors: list[float], over: int = 20) -> bool:
    """True if the last ``over`` rounds took less than a hundredth off the error: the targets cannot all be met."""
    return len(errors) > over and errors[-1] > 0.99 * errors[-1 - over]

Targets = dict[str, "dict[str, float] | float"]


class Bags:
    """A text's hashed word counts and its number of words (cut at ASCII white space)."""

    def __init__(self, dims: int, memory: int = 200_000):
        self.dims, self.memory, self.known = dims, memory, {}

    def __call__(self, text: str) -> tuple[bytes, int]:
        words, known = text.encode().lower().split(), self.known
        try:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) > self.memory:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh32_intdigest(w.strip(b".,;:!?\"'()")) % self.dims
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.bincount(at, minlength=self.dims).astype(np.uint32).tobytes(), len(words)


def with_bags(docs: DataFrame, keep: list[str], text_col: str = "text", dims: int = 512) -> DataFrame:
    """``keep`` with bag (hashed word counts of the whole text, null without words) and n_tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Bags(dims)
        for batch in sliced(batches):
            found = [count(t) if t else (None, 0) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x if n else None for x, n in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["who", "bag", "n_tokens"])

    kinds = dict(docs.dtypes)
    who = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in keep) + ">"
    found = docs.select(F.struct(*keep).alias("who"), F.col(text_col).alias("text")).mapInArrow(rows, f"who {who}, bag binary, n_tokens long")
    return found.select(*(F.col(f"who.{c}").alias(c) for c in keep), "bag", "n_tokens")


def _units(bags: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Square roots of the counts in each bag, which is not null, to unit length, in single precision.

    The squares of the roots add up to the count of all words, so no norm has to be taken."""
    column = bags.cast(pa.large_binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = int(np.frombuffer(column.buffers()[1], np.int64)[column.offset]) if len(column) else 0
    counts = np.frombuffer(column.buffers()[2], np.uint32, len(column) * dims, at).reshape(-1, dims) if len(column) else np.empty((0, dims), np.uint32)
    x = np.sqrt(counts, dtype=np.float32)
    x /= np.sqrt(np.maximum(1, counts.sum(axis=1, dtype=np.int64)))[:, None].astype(np.float32)
    return x


SUMS = "topic long, n long, fit double, total binary"
#: Vectors count in this unit. So the products and sums of vectors are sums of whole numbers under 2 ** 53, which
#: come out the same in whatever order and batches they are taken.
UNIT = float(1 << 20)


def _whole(x: np.ndarray) -> np.ndarray:
    """Unit vectors as doubles that are whole numbers of ``UNIT``."""
    return np.rint(x * x.dtype.type(UNIT)).astype(float)


def _worst(found: dict[bytes, float], most: int) -> dict[bytes, float]:
    """The ``most`` vectors of the lowest fit; the first by their bytes of equal ones."""
    return dict(sorted(found.items(), key=lambda r: (r[1], r[0]))[:most])


def _cell_sums(centroids: np.ndarray):
    """For each task: of every cell the number of rows and the sum of their vectors; and, as topic -1, the different vectors that fit worst."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, near = len(centroids), _whole(centroids).T
        n, total, worst = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = _whole(_units(batch.column(0).slice(at, 2048), centroids.shape[1]))
                score = x @ near
                cell, best = score.argmax(axis=1), score.max(axis=1)
                n += np.bincount(cell, minlength=k)
                total += ((np.arange(k)[:, None] == cell).astype(float) @ x).astype(np.int64)
                bar, least = max(worst.values()) if len(worst) == k else np.inf, {}
                for i in np.argsort(best, kind="stable"):
                    if best[i] > bar or len(least) >= k and best[i] > max(least.values()):
                        break
                    least[x[i].astype(np.int64).tobytes()] = float(best[i])
                worst |= least
                worst = _worst(worst, k)
        some = np.flatnonzero(n)
        if len(some):
            sums = [total[i].tobytes() for i in some] + list(worst)
            yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), *[-1] * len(worst)]), pa.array([*n[some].tolist(), *[1] * len(worst)]), pa.array([0.0] * len(some) + list(worst.values())), pa.array(sums, pa.binary())], names=["topic", "n", "fit", "total"])

    return rows


def _added(most: int):
    """The sums of a cell's rows added up; of topic -1 the ``most`` vectors that fit worst."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, worst = {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["topic"] < 0:
                    worst = _worst(worst | {r["total"]: r["fit"]}, most)
                else:
                    n, total = sums.get(r["topic"], (0, 0))
                    sums[r["topic"]] = (n + r["n"], total + np.frombuffer(r["total"], np.int64))
        out = [(k, n, 0.0, t.tobytes()) for k, (n, t) in sums.items()] + [(-1, 1, fit, t) for t, fit in worst.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.binary()))], names=["topic", "n", "fit", "total"])

    return rows


def fit_topics(bags: DataFrame, key_col: str, topics: int = 8, dims: int = 512, start_rows: int = 4096, rounds: int = 20, close: float = 1e-6) -> np.ndarray:
    """Unit topic centroids: spherical k-means over all ``bags``.

    It starts from the centroids of at most ``start_rows`` rows whose keys hash lowest, one for each key. In each round the executors assign
    every row and add up vectors and counts of each cell, in whole numbers (``UNIT``), so partitions and batches change
    nothing; only these sums come to the driver. An empty cell takes a row that fits worst. It ends when no centroid moves by more than ``close`` (one less the cosine), or after ``rounds``.
    """
    words, hashed = bags.where("n_tokens > 0"), F.xxhash64(key_col)
    last = words.select(hashed.alias("h")).distinct().orderBy("h").limit(start_rows).agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros((1, dims))
    first = words.select("bag", hashed.alias("h")).where(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h")
    x = _units(first.select("bag").toArrow().column("bag"), dims).astype(float)
    c = spherical_kmeans(x, min(topics, len(x)))
    for _ in range(rounds):
        sums = words.select("bag").mapInArrow(_cell_sums(c), SUMS).repartition("topic").mapInArrow(_added(len(c)), SUMS).collect()
        now = np.zeros_like(c)
        for r in sums:
            if r.topic >= 0:
                now[r.topic] = np.frombuffer(r.total, np.int64)
        worst = [np.frombuffer(r.total, np.int64) for r in sorted((r for r in sums if r.topic < 0), key=lambda r: (r.fit, bytes(r.total)))]
        for k, v in zip(np.flatnonzero(~now.any(axis=1)), worst):
            now[k] = v
        norm = np.linalg.norm(now, axis=1, keepdims=True)
        now = np.where(norm > 0, now / np.where(norm > 0, norm, 1), c)
        moved, c = float((1 - (now * c).sum(axis=1)).max()), now
        if moved <= close:
            break
    return c


def _placed(centroids: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _whole(centroids).T
        for batch in batches:
            bags, topic = batch.column(1), np.full(batch.num_rows, NONE, object)
            some = np.flatnonzero(bags.is_valid().to_numpy(zero_copy_only=False))
            for k in range(0, len(some), 2048):
                at = some[k : k + 2048]
                cell = (_whole(_units(bags.take(pa.array(at)), centroids.shape[1])) @ near).argmax(axis=1)
                topic[at] = [f"t{i}" for i in cell]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(topic.tolist(), pa.string())], names=["who", "topic"])

    return rows


def with_topics(bags: DataFrame, centroids: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` with topic (nearest centroid; ``(none)`` without words) of each of ``bags``."""
    kinds = dict(bags.dtypes)
    who = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in keep) + ">"
    found = bags.select(F.struct(*keep).alias("who"), "bag").mapInArrow(_placed(centroids), f"who {who}, topic string")
    return found.select(*(F.col(f"who.{c}").alias(c) for c in keep), "topic")


def target_shares(mass: dict[str, float], target: dict[str, float] | float) -> dict[str, float]:
    """Shares that add to one: given ones (what they leave goes to the rest by mass), or mass to the power given."""
    total = sum(mass.values()) or 1.0
    if isinstance(target, dict):
        rest = sum(m for c, m in mass.items() if c not in target) or 1.0
        left = max(0.0, 1 - sum(target.values()))
        raw = {c: float(target.get(c, left * m / rest)) for c, m in mass.items()}
    else:
        raw = {c: (m / total) ** float(target) if m > 0 else 0.0 for c, m in mass.items()}
    scale = sum(raw.values()) or 1.0
    return {c: v / scale for c, v in raw.items()}


def rake(cells: list[tuple], mass: np.ndarray, targets: Targets, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Weights of ``cells`` (category tuples in the order of ``targets``) whose marginals are the targets.

    Each step scales the cells of every category to its share; it ends when all marginals are ``close`` or get no closer. Returns also
    the largest error left, which stays over ``close`` only if empty cells make the targets impossible.
    """
    w, total, error = mass.astype(float).copy(), float(mass.sum()), 0.0
    dims = []
    for d, target in enumerate(targets.values()):
        names, at = np.unique(np.array([c[d] for c in cells], object).astype(str), return_inverse=True)
        own = dict(zip(names.tolist(), np.bincount(at, weights=mass, minlength=len(names)).tolist()))
        share = target_shares(own, target)
        dims.append((at, np.array([share[n] for n in names.tolist()]) * total))
    errors: list[float] = []
    for _ in range(rounds):
        error = 0.0
        for at, goal in dims:
            now = np.bincount(at, weights=w, minlength=len(goal))
            error = max(error, float(np.abs(now - goal).max()) / max(total, 1e-12))
            w *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        errors.append(error)
        if error <= close or stalled(errors):
            break
    return w, error


def rake_frame(cells: DataFrame, targets: Targets, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """The same steps as joins and aggregations of Spark, for more cells than the driver may hold: ``cells`` with ``w``,
    and the largest error left. Sums are of decimals, which have no order."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,18)")).cast("double")
    total = cells.agg(F.sum("mass")).first()[0] or 0
    w, goals = cells.withColumn("w", F.col("mass").cast("double")), {}
    for d, target in targets.items():
        own = cells.groupBy(d).agg(F.sum("mass").alias("m"))
        if isinstance(target, dict):
            given = F.create_map(*(F.lit(x) for pair in target.items() for x in pair)) if target else F.create_map().cast("map<string,double>")
            rest = own.where(~F.col(d).isin(list(target))).agg(F.sum("m")).first()[0] or 1.0
            raw = own.select(d, F.coalesce(given[F.col(d)], F.lit(max(0.0, 1 - sum(target.values()))) * F.col("m") / rest).alias("g"))
        else:
            raw = own.select(d, F.when(F.col("m") > 0, F.pow(F.col("m") / total, F.lit(float(target)))).otherwise(0.0).alias("g"))
        scale = raw.agg(exact("g")).first()[0] or 1.0
        goals[d] = written(raw.select(d, (F.col("g") / scale * total).alias("goal")), "goal")
    error, errors = 0.0, []
    for _ in range(rounds):
        error = 0.0
        for d, goal in goals.items():
            now = written(w.groupBy(d).agg(exact("w").alias("now")).join(goal, d), "marginal")
            error = max(error, (now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0) / max(total, 1e-12))
            w = w.join(now, d).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col("goal") / F.col("now")).otherwise(0.0)).drop("now", "goal")
        w = written(w, "cells")
        errors.append(error)
        if error <= close or stalled(errors):
            break
    return w, error


def mix(placed: DataFrame, targets: Targets, key_col: str, budget: float = 1.0, seed: int = 17, driver_cells: int = 200_000, tolerance: float = 1e-4, strict: bool = False) -> DataFrame:
    """``placed`` (key_col, the columns of ``targets``, n_tokens) with weight and copies for each row.

    The token mass of every cell of categories is raked to the targets' marginals (shares of tokens, or a power of the
    present shares; null is a category of its own). weight is the expected number of copies, the same all over a cell:
    raked over present mass, times ``budget`` (tokens wanted as a share of those there). copies is its whole part, plus
    one with the probability of the rest, by a hash of the key and ``seed``: the same on every run and any partitioning.
    Cells, not documents, come to the driver, and only if at most ``driver_cells``; more are raked by Spark. Cells
    without tokens have weight ``budget``. If raking leaves a marginal off by over ``tolerance`` of all tokens, as it must
    when empty cells make targets impossible, that is a warning, or an error if ``strict``. Rows that repeat a key get the same copies. Empty tables give no rows.
    """
    dims = list(targets)
    rows = placed.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in dims})
    cells = written(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("mass")), "cells")
    n = cells.count()
    if n <= driver_cells:
        found = sorted(tuple(r) for r in cells.collect())
        mass = np.array([float(r[-1] or 0) for r in found])
        w, error = rake([r[:-1] for r in found], mass, targets) if found else (mass, 0.0)
        factor = np.divide(w, mass, out=np.ones_like(w), where=mass > 0) * budget
        schema = pa.schema([(d, pa.string()) for d in dims] + [("weight", pa.float64())])
        arrays = [pa.array([r[k] for r in found], pa.string()) for k in range(len(dims))] + [pa.array(factor)]
        weights = F.broadcast(placed.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, schema=schema)))
    else:
        raked, error = rake_frame(cells, targets)
        weights = raked.select(*dims, F.when(F.col("mass") > 0, F.col("w") / F.col("mass") * budget).otherwise(budget).alias("weight"))
    if error > tolerance:
        message = f"the marginals miss their targets by up to {error:.2g} of all tokens: the cells present cannot meet them all"
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key_col), F.lit(seed)), 11) / F.lit(float(1 << 53))).cast("double")
    whole = F.floor("weight")
    return rows.join(weights, dims, "left").withColumn("copies", (whole + F.when(u < F.col("weight") - whole, 1).otherwise(0)).cast("int"))


PRODUCTION: Targets = {"source": 0.7, "lang": 0.7, "topic": 0.5}  # flatter shares of sources, languages and topics


def mix_documents(docs: DataFrame, targets: Targets = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", budget: float = 1.0) -> DataFrame:
    """row_key, the id, source, lang, topic, n_tokens, weight and copies of every row; see ``fit_topics`` (over all documents) and ``mix``."""
    others = [c for c in targets if c != "topic"]
    rows = keyed_rows(docs, id_col, text_col, *others)
    bags = written(with_bags(rows, ["row_key", id_col, *others], text_col), "bags")
    placed = written(with_topics(bags, fit_topics(bags, "row_key"), ["row_key", id_col, *others, "n_tokens"]), "placed")
    return mix(placed, targets, "row_key", budget)
