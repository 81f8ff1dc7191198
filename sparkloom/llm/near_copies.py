"""Near copies by similarity: wide SimHash fingerprints propose links, shingle sets of whole texts confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.arrays import unite, utf8_rows, whole_groups
from sparkloom.llm.components import connected_components
from sparkloom.llm.shared import keyed_rows, small_side, written
from sparkloom.llm.simhash import in_pieces

LANES = 4
BITS = 64 * LANES
FP = [f"f{k}" for k in range(LANES)]


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different XXH64 hashes of each text's shingles, end to end, and the texts' offsets in them.

    Words are as in ``simhash_groups``: lower-cased over A-Z, cut at ASCII white space; fewer make one shingle.
    """
    found = list(in_pieces(texts, words))
    h, of = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def wide_fingerprints(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The SimHash of 256 bits of each set: a bit is set if set in over half of the hashes; the empty set has zero.

    Eight bits are counted at once in the bytes of a word, over at most 255 hashes.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    ones = np.zeros((n, LANES, 8, 8), np.int64)
    if len(h):
        of = np.repeat(np.arange(n), size)
        heads = np.flatnonzero((np.arange(len(h)) - offsets[of]) % 255 == 0)
        some = np.flatnonzero(size)
        firsts = np.searchsorted(of[heads], some)
        with np.errstate(over="ignore"):
            for lane in range(LANES):
                g = h + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
                g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                g ^= g >> np.uint64(31)
                for bit in range(8):
                    counts = np.add.reduceat((g >> np.uint64(bit)) & np.uint64(0x0101010101010101), heads).view(np.uint8).reshape(-1, 8)
                    ones[some, lane, :, bit] = np.add.reduceat(counts, firsts, axis=0, dtype=np.int64)
    return np.packbits((ones * 2 > size[:, None, None, None]).reshape(n, BITS), axis=1, bitorder="little").view(np.uint64)


def _sketches(words: int, bytes_at_once: int = 2 << 20):
    """Digest of the shingle set and fingerprint of each text."""

    def found(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        h, offsets = shingle_sets(texts, words)
        return [hashlib.md5(h[a:b].tobytes()).digest() for a, b in zip(offsets[:-1], offsets[1:])], wide_fingerprints(h, offsets)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps, waiting, size = [], [np.empty((0, LANES), np.uint64)], [], 0
            for k, raw in enumerate(utf8_rows(batch.column(1)), 1):
                waiting.append(raw)
                size += len(raw)
                if size >= bytes_at_once or k == batch.num_rows:
                    d, f = found(waiting)
                    digests += d
                    fps.append(f)
                    waiting, size = [], 0
            fp = np.concatenate(fps).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(LANES))], names=["who", "digest", *FP])

    return rows


def turned(similarity: float) -> float:
    """The chance that a bit differs between sets of that Jaccard similarity: their angle is at most this share of pi."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_radius(similarity: float) -> int:
    """Bits that sets of that similarity differ in, and five standard deviations more."""
    p = turned(similarity)
    return int(BITS * p + 5 * np.sqrt(BITS * p * (1 - p)))


def band_bits(n: int, similarity: float, miss: float, rows: int = 512) -> np.ndarray:
    """Bit positions of each band: so wide that ``n`` fingerprints share a bucket by about ``rows``, and so many that a
    pair just as similar as asked agrees on none with a chance of ``miss``."""
    width = max(4, int(np.ceil(np.log2(max(1, n) / rows))))
    bands = int(np.ceil(np.log(miss) / np.log1p(-((1 - turned(similarity)) ** width))))
    rng = np.random.default_rng(5)
    return np.stack([rng.choice(BITS, width, replace=False) for _ in range(bands)])


def _banded(positions: np.ndarray):
    powers = 1 << np.arange(positions.shape[1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fingerprint_columns(batch)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
            for band, at in enumerate(positions):
                value = bits[:, at] @ powers
                yield pa.RecordBatch.from_arrays([batch.column("node"), *(batch.column(f) for f in FP), pa.array(np.full(len(value), band)), pa.array(value.astype(np.int64))], names=["node", *FP, "band", "value"])

    return rows


def _fingerprint_columns(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy() for f in FP], axis=1).view(np.uint64)


def _near(fp: np.ndarray, radius: int, parent: np.ndarray, confirm: Callable | None = None, step: int = 128, tile: int = 2048) -> None:
    """Joins in ``parent`` all rows linked within ``radius`` bits and, if given, confirmed."""
    for a in range(0, len(fp), step):
        rows = slice(a, min(a + step, len(fp)))
        for b in range(a, len(fp), tile):
            cols = slice(b, min(b + tile, len(fp)))
            apart = sum(np.bitwise_count(fp[rows, None, k] ^ fp[None, cols, k]).astype(np.int16) for k in range(LANES))
            i, j = np.nonzero((apart <= radius) & (parent[rows, None] != parent[None, cols]))
            if not len(i):
                continue
            if confirm is None:
                unite(parent, i + a, j + b)
                continue
            for x in np.argsort(apart[i, j], kind="stable"):
                u, v = int(i[x]) + a, int(j[x]) + b
                if parent[u] != parent[v] and confirm(u, v):
                    unite(parent, np.array([u]), np.array([v]))


def _forest(keys: list[str], radius: int, similarity: float | None = None, words: int = 5):
    """Edges from each row to the root of its set in its group. With a similarity, links are confirmed by the texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, keys):
            fps, node = _fingerprint_columns(table), table.column("node").to_numpy()
            for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
                if b - a < 2:
                    continue
                parent, confirm = np.arange(b - a), None
                if similarity is not None:
                    h, at = shingle_sets(list(utf8_rows(table.column("text").slice(a, b - a).combine_chunks())), words)

                    def confirm(u: int, v: int) -> bool:
                        x, y = h[at[u] : at[u + 1]], h[at[v] : at[v + 1]]
                        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                            return False
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        return both >= similarity * (len(x) + len(y) - both) - 1e-9

                _near(fps[a:b], radius, parent, confirm)
                child = np.flatnonzero(parent != np.arange(b - a))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a:b][child]), pa.array(node[a:b][parent[child]])], names=["a", "b"])

    return rows


def _in_groups(rows: DataFrame, keys: list[str], most: int, broadcast_bytes: int) -> DataFrame:
    """``rows`` sorted by ``keys`` and part; groups over ``most`` rows are cut in parts, every two of which meet.

    The groups so large are broadcast if they take at most ``broadcast_bytes``, else joined.
    """
    large = small_side(written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most), "large"), broadcast_bytes)
    n_parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(most))
    own = F.pmod(F.xxhash64("node"), n_parts)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n_parts - 1), lambda j: F.least(own, j) * n_parts + F.greatest(own, j))
    dealt = rows.join(large, keys, "left").select(*rows.columns, F.explode(pairs).alias("part"))
    return dealt.repartition(*keys, "part").sortWithinPartitions(*keys, "part")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, miss: float = 3e-4, bucket_rows: int = 4096, member_rows: int = 1024, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """row_key, the id, component (smallest id reachable over links) and kept of every row.

    Two texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more.
    Candidates are SimHash fingerprints of 256 bits within ``wide_radius``, met in buckets of random bands of bits, which
    a link just as similar as asked misses with a chance of about ``miss`` (a closer one with less). Each link is
    confirmed over the whole texts, within the components of the candidates: those hold all links found. Equal sets
    are one class. Texts without words (null, empty, blank) are one class of their own. kept, ids, repeated rows and
    empty tables are as in ``simhash_groups``.
    """
    rows, kind, radius = keyed_rows(docs, id_col, text_col), dict(docs.dtypes)[id_col], wide_radius(similarity)
    who = rows.select(F.struct("row_key", id_col).alias("who"), text_col)
    found = who.mapInArrow(_sketches(words), f"who struct<row_key: bigint, {id_col}: {kind}>, digest binary, " + ", ".join(f"{f} long" for f in FP))
    found = written(found.select("who.row_key", F.col(f"who.{id_col}"), "digest", *FP), "sketches")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row_key")).alias("first")
    classes = written(found.groupBy("digest", *FP).agg(F.min(id_col).alias("smallest"), F.min("row_key").alias("node"), first), "classes")

    positions = band_bits(classes.count(), similarity, miss)
    banded = classes.select("node", *FP).mapInArrow(_banded(positions), "node long, " + ", ".join(f"{f} long" for f in FP) + ", band long, value long")
    keys = ["band", "value"]
    near = connected_components(_in_groups(banded, keys, bucket_rows, broadcast_bytes).mapInArrow(_forest([*keys, "part"], radius), "a long, b long"))
    members = near.select("component", "node").union(near.select("component", F.col("component").alias("node")).distinct())
    members = written(members.join(classes.select("node", *FP), "node"), "members")

    texts = rows.select(F.col("row_key").alias("node"), F.col(text_col).alias("text"))
    small = small_side(members, broadcast_bytes)
    met = _in_groups(texts.join(small, "node").select("component", "node", *FP, "text"), ["component"], member_rows, broadcast_bytes)
    groups = connected_components(met.mapInArrow(_forest(["component", "part"], radius, similarity, words), "a long, b long"))

    placed = classes.join(groups, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    names = placed.groupBy("root").agg(F.min("smallest").alias("component"), F.min("first").alias("first"))
    by_class = placed.select("digest", "root").join(names, "root").select("digest", "component", F.col("first.row_key").alias("first"))
    return found.join(by_class, "digest").select("row_key", id_col, "component", (F.col("row_key") == F.col("first")).alias("kept"))
