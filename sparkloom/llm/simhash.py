"""Operator 4: SimHash fingerprints and exact links within a Hamming radius, by tiles of population counts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.arrays import unite, utf8_rows, whole_groups
from sparkloom.llm.components import connected_components
from sparkloom.llm.shared import keyed_rows, written

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


_space = re.compile(rb"[ \t-\r]").search


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_slices(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of raw[start[i]:end[i]] for each i, vectorised over the slices. ``raw`` is uint8."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    lanes8 = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 8,), (1,))
    lanes4 = np.lib.stride_tricks.as_strided(padded[:4].view(np.uint32), (len(padded) - 8,), (1,))
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        size = (end - start).astype(np.int64)
        at = start.astype(np.int64).copy()
        h = np.full(len(at), s + P5)
        big = np.flatnonzero(size >= 32)
        if len(big):
            acc = [np.full(len(big), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
            stripes, k, here = size[big] // 32, 0, np.arange(len(big))
            while len(here := here[stripes[here] > k]):
                p = at[big[here]] + 32 * k
                for x in range(4):
                    acc[x][here] = _round(acc[x][here], lanes8[p + 8 * x])
                k += 1
            merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                merged = (merged ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[big] = merged
            at[big] += 32 * stripes
        h += size.astype(np.uint64)
        for _ in range(3):
            i = np.flatnonzero(end - at >= 8)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), lanes8[at[i]]), 27) * P1 + P4
            at[i] += 8
        i = np.flatnonzero(end - at >= 4)
        if len(i):
            h[i] = _rotl(h[i] ^ (lanes4[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
            at[i] += 4
        for _ in range(3):
            i = np.flatnonzero(end > at)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (padded[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


PIECE = 1 << 20  # bytes of a text cut into words at a time


def pieces_of(raw: bytes, words: int) -> Iterator[bytes]:
    """The lower-cased words of a text, space-joined, in pieces of about ``PIECE`` bytes that together hold each shingle of
    ``words`` words once: all but the first begin with the last words of the one before. Fewer words are one piece."""
    begin, before, first = 0, [], True
    while begin < len(raw):
        end = len(raw)
        if end - begin > PIECE:
            space = _space(raw, begin + PIECE)
            end = space.start() if space else end
        now = before + raw[begin:end].lower().split()
        begin = end
        if len(now) >= words or now and first and begin >= len(raw):
            yield b" ".join(now)
            before, first = now[len(now) - words + 1 :] if words > 1 else [], False
        else:
            before = now


def shingle_hashes(pieces: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of ``pieces`` (space-joined words; fewer than ``words`` are one shingle), and whose each is, in order."""
    raw = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.append(0, ends[:-1] + 1)
    last = np.cumsum(np.array([len(t) + 1 for t in pieces], np.int64)) - 1
    of = np.searchsorted(last, starts).astype(np.int32)
    n_words = np.bincount(of, minlength=len(pieces))
    lead = np.flatnonzero(of[: len(of) - words + 1] == of[words - 1 :]) if len(of) >= words else np.empty(0, np.int64)
    short = np.flatnonzero(n_words < words)
    whose = np.concatenate([of[lead], short.astype(np.int32)])
    h = xxh64_slices(raw, np.concatenate([starts[lead], np.append(0, last[:-1] + 1)[short]]), np.concatenate([ends[lead + words - 1], last[short]]))
    if len(short):
        order = np.argsort(whose, kind="stable")
        h, whose = h[order], whose[order]
    return h, whose


def in_pieces(texts: Iterable[bytes], words: int, bytes_at_once: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingle hashes of ``texts`` and the number of each one's text, some bytes at a time; long texts come in parts."""
    pieces, owners, size = [], [], 0
    for k, raw in enumerate(texts):
        for piece in pieces_of(raw, words):
            pieces.append(piece)
            owners.append(k)
            size += len(piece)
            if size >= bytes_at_once:
                h, whose = shingle_hashes(pieces, words)
                yield h, np.array(owners)[whose]
                pieces, owners, size = [], [], 0
    if pieces:
        h, whose = shingle_hashes(pieces, words)
        yield h, np.array(owners)[whose]


def fingerprints_of(texts: Iterable[bytes], n: int, words: int = 4, at_once: int = 1 << 16) -> np.ndarray:
    """The 64-bit SimHash of each of the ``n`` texts over shingles of ``words`` words, repeats included."""
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for hashes, owner in in_pieces(texts, words):
        total += np.bincount(owner, minlength=n)
        for k in range(0, len(hashes), at_once):
            h, of = hashes[k : k + at_once], owner[k : k + at_once]
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.diff(of, prepend=-1))
            ones[of[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(utf8_rows(batch.column(1)), batch.num_rows, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["row_key", "fp"])

    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """row_key, the id and fp (long) for each row. Null or blank text has fingerprint zero."""
    rows = keyed_rows(docs, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    both = rows.select(F.struct("row_key", id_col).alias("who"), text_col)
    found = both.mapInArrow(_fingerprint_rows(words), f"who struct<row_key: bigint, {id_col}: {kind}>, fp long")
    return found.select("who.row_key", F.col(f"who.{id_col}"), "fp")


def block_masks(radius: int, keep: int, bits: int = 64) -> list[int]:
    """Masks such that two words at most ``radius`` bits apart agree on all bits of some mask (pigeonhole)."""
    n = radius + keep
    edges = [bits * k // n for k in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(n), keep)]


def tile_links(fp: np.ndarray, radius: int, tile: int = 2048, lows: int | None = None) -> np.ndarray:
    """The smallest linked position of each fingerprint, by tiles of exclusive-or and bit counts.

    Fingerprints come sorted by population count; tile pairs whose counts differ by more than ``radius`` are skipped.
    The first ``lows`` (all, if not given) meet every other; those behind them do not meet each other.
    """
    pop = np.bitwise_count(fp)
    parent = np.arange(len(fp))
    step, lows = 128, len(fp) if lows is None else lows
    for a in range(0, lows, step):
        rows = slice(a, min(a + step, lows))
        for b in range(a, len(fp), tile):
            if int(pop[b]) - int(pop[rows.stop - 1]) > radius:
                break
            cols = slice(b, min(b + tile, len(fp)))
            near = np.bitwise_count(fp[rows, None] ^ fp[None, cols]) <= radius
            near &= parent[rows, None] != parent[None, cols]
            i, j = np.nonzero(near)
            if len(i):
                unite(parent, i + a, j + b)
    return parent


MEETING = ["tile", "mask", "value", "finer", "rest", "part"]


def _linked(radius: int):
    """Within each meeting, edges from each fingerprint's row to the root of its set there: a forest, never all pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, offsets in whole_groups(batches, MEETING):
            fp, node, tile = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy(), table.column("tile").to_numpy()
            a_out, b_out = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if b - a < 2:
                    continue
                f = fp[a:b]
                pop = np.bitwise_count(f)
                order = np.argsort(pop, kind="stable")
                parent = tile_links(f[order], radius, lows=int((pop // (radius + 1) == tile[a]).sum()))
                child = np.flatnonzero(parent != np.arange(b - a))
                if len(child):
                    own = node[a:b][order]
                    a_out.append(own[child])
                    b_out.append(own[parent[child]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return rows


def _masked(masks: list[int], mask: str, value: str) -> Column:
    """An array with, for each mask, its number and the fingerprint's bits under it."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(k).cast("long").alias(mask), F.col("fp").bitwiseAND(F.lit(m)).alias(value)) for k, m in enumerate(signed)))


def near_fingerprints(classes: DataFrame, radius: int = 4, keep: int | None = None, bucket_rows: int = 4096, most_parts: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all of ``classes`` (fp, node; distinct fp) within ``radius`` bits, as forests.

    Fingerprints are dealt to tiles by population count, radius + 1 counts a band: a tile is a band and the one above
    it, and its lower band is compared with both. Other pairs of bands are never met: their counts differ too much.
    Inside a tile, only fingerprints that agree on some pigeonhole mask are compared, which loses no link and keeps work
    from growing with the square of the corpus. ``keep`` blocks of radius + keep are masked in; by default as few as
    hold an average bucket under ``bucket_rows``. Larger buckets are cut in parts, every two of which meet in a task of
    their own; if that took over ``most_parts`` parts (as many as finer masks), by finer masks first.
    """
    if keep is None:
        n, keep = classes.count(), 1
        while keep < 4 and n >> (64 * keep // (radius + keep)) > bucket_rows:
            keep += 1
    finer = block_masks(radius, keep + 2)
    most_parts = len(finer) if most_parts is None else most_parts
    band = F.floor(F.bit_count("fp") / (radius + 1)).cast("long")
    rows = classes.select("fp", "node", F.explode(F.array(band, band - 1)).alias("tile")).where("tile >= 0")
    rows = rows.select("fp", "node", "tile", F.explode(_masked(block_masks(radius, keep), "mask", "value")).alias("at")).select("fp", "node", "tile", "at.*")
    bucket = ["tile", "mask", "value"]

    def sized(rows: DataFrame, keys: list[str]) -> DataFrame:
        large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
        return rows.join(large, keys, "left").withColumn("n_parts", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(bucket_rows))).drop("n")

    def dealt(rows: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), F.col("n_parts"))
        # part of a pair (i, j), i <= j: own part meets every other
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1), lambda j: F.least(own, j) * F.col("n_parts") + F.greatest(own, j))
        return rows.select("fp", "node", *MEETING[:-1], F.explode(pairs).alias("part"))

    rows = sized(rows, bucket)
    cut = rows.where(F.col("n_parts") <= most_parts).withColumns({"finer": F.lit(-1).cast("long"), "rest": F.lit(0).cast("long")})
    huge = rows.where(F.col("n_parts") > most_parts).select("fp", "node", *bucket, F.explode(_masked(finer, "finer", "rest")).alias("at")).select("fp", "node", *bucket, "at.*")
    met = dealt(cut).unionByName(dealt(sized(huge, [*bucket, "finer", "rest"])))
    return met.repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(_linked(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """row_key, the id, fp (long), component (smallest id reachable over links of ``radius`` bits at most) and kept.

    kept is true for one row_key of each component: that of the smallest id, nulls last.

    Texts are lower-cased over A-Z and cut at ASCII white space; shingles of ``words`` words, repeats included, are
    hashed with XXH64 (seed 42); a bit is set if set in over half of them. Fewer words make one shingle; none (null,
    empty, blank) give fingerprint zero, linked like any other. Ids are integers; rows that repeat an id share its
    component if their texts do. A null id links by its text, and its component is the smallest non-null id or null.
    An empty table gives no rows. Other columns are ignored.
    """
    found = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min(id_col).alias("smallest"), F.min("row_key").alias("node"), F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row_key")).alias("first")), "classes")
    groups = connected_components(near_fingerprints(classes.select("fp", "node"), radius))
    placed = classes.join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    names = placed.groupBy("root").agg(F.min("smallest").alias("component"), F.min("first").alias("first"))
    by_fp = placed.select("fp", "root").join(names, "root").select("fp", "component", F.col("first.row_key").alias("first"))
    return found.join(by_fp, "fp").select("row_key", id_col, "fp", "component", (F.col("row_key") == F.col("first")).alias("kept"))
