"""Operator 3: repeated byte strings, by prefix doubling over content-sampled positions."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.arrays import group_starts, utf8_rows
from sparkloom.llm.shared import keyed_rows, written

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE = 1 << 18  # positions handled at a time; longer texts are cut with an overlap, which changes nothing
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        up = np.full(n, MULTIPLIER)
        down = np.full(n, INVERSE)
        up[0] = down[0] = 1
        _powers[n] = np.cumprod(up), np.cumprod(down)
    return _powers[n]


def runs_of_anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``length`` bytes, in runs that share their anchor: first window, windows, anchor, its hash.

    The anchor of a window is the leftmost position in its first half whose half-length string has the least hash.
    That depends on the window's bytes alone, so equal windows have equal anchors at equal distances.
    """
    half, n = length // 2, len(text) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    reach = length - half  # anchors of window s are s .. s + reach
    out: list[tuple[np.ndarray, ...]] = []
    up, down = _power_tables(SLICE + 2 * length + 1)
    for base in range(0, n, SLICE):
        part = text[base : base + SLICE + length - 1]
        m = len(part)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:m], out=sums[1:])
        h = (sums[half:] - sums[:-half]) * down[: m - half + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        at = np.arange(len(h), dtype=np.uint64)
        low = (h & ~np.uint64((1 << 20) - 1)) | at
        width = 1
        while width * 2 <= reach + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = reach + 1 - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(start, append=len(anchor))
        out.append((start + base, count, anchor[start] + base, h[anchor[start]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _segments(length: int):
    """A row for each run of windows: the rank key of its anchor's half, and the digest of all its bytes.

    Runs that repeat within the batch are counted here: one stands for them, the others leave as done, under keys of
    their own. So a very common string sends a row or so from each batch, however often it occurs.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, raw in zip(batch.column(0).to_numpy(), utf8_rows(batch.column(1))):
                start, count, anchor, key = runs_of_anchors(np.frombuffer(raw, np.uint8), length)
                if len(start):
                    ends, leads = (start + count + length - 1).tolist(), (anchor - start).tolist()
                    whole = [xxhash.xxh3_64_intdigest(raw[s:e], seed=d) for s, e, d in zip(start.tolist(), ends, leads)]
                    parts.append((np.full(len(start), doc, np.int64), start, count, anchor, key.view(np.int64), np.array(whole, np.uint64).view(np.int64)))
            if not parts:
                continue
            doc, start, count, anchor, key, whole = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((whole, key))
            same = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            done, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
            done[order[1:][same]] = True
            many[order[:-1][same]] = True
            many |= done
            spread = (doc * 1_000_003 + start) ^ key
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc),
                    pa.array(start.astype(np.int32)),
                    pa.array(count.astype(np.int16)),
                    pa.array((anchor - start).astype(np.int16)),
                    pa.array(np.where(done, spread, key)),
                    pa.array(whole),
                    pa.array(np.where(done, 0, np.where(many, 2, 1)).astype(np.int8)),
                ],
                names=["row_key", "start", "count", "lead", "key", "whole", "weight"],
            )

    return rows


def _frequent(length: int, counters: int = 4096):
    """Misra-Gries counts of anchor keys over a task: no key with more than a share of 1 / ``counters`` is missing, and
    counts are at most so much too low. The null key counts all rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for batch in batches:
            found = [runs_of_anchors(np.frombuffer(raw, np.uint8), length)[3] for raw in utf8_rows(batch.column(1))]
            here = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            total += len(here)
            new, times = np.unique(here, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
            if len(keys) > counters:
                counts -= np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys.tolist()], pa.int64()), pa.array([total, *counts.tolist()], pa.int64())], names=["key", "n"])

    return rows


def ranked_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A pass over rows that Spark sorted by key, salt and whole: (rows, first of each run, times, mixed, the others).

    A run is the rows equal in key, salt and whole. times is the sum of their weights; mixed tells whether the key has
    another run, or is crowded (split over tasks). Only one row waits for the next batch, however long a run or a
    key is: the first of the last run, with what is known of it as its weight and crowded.
    """
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        parts = [x for x in (held, batch) if x is not None]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        key, salt, whole = (table.column(c).to_numpy() for c in ("key", "salt", "whole"))
        weight, crowded = table.column("weight").to_numpy(), table.column("crowded").to_numpy()
        heads, firsts = group_starts([key, salt]), group_starts([key, salt, whole])
        times = np.add.reduceat(weight.astype(np.int64), firsts)
        of = np.searchsorted(heads, firsts, side="right") - 1
        mixed = (np.bincount(of)[of] > 1) | np.logical_or.reduceat(crowded, heads)[of]
        others = np.setdiff1d(np.arange(len(key)), firsts, assume_unique=True)
        if batch is None:
            yield table, firsts, times, mixed, others
            return
        last = table.slice(int(firsts[-1]), 1)
        last = last.set_column(last.schema.get_field_index("weight"), "weight", pa.array([min(int(times[-1]), 2)], pa.int8()))
        last = last.set_column(last.schema.get_field_index("crowded"), "crowded", pa.array([bool(mixed[-1])]))
        held = last.select(batch.schema.names).combine_chunks().to_batches()[0].cast(batch.schema)
        yield table, firsts[:-1], times[:-1], mixed[:-1], others


FIRST = "row_key long, start int, count short, lead short, key long, salts int, state byte"
DONE, LONE, WITNESS = 0, 1, 2


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that repeat as a whole, as done; of mixed keys, the first of each run to be ranked further.

    A witness is decided itself, but others may repeat a part of it. Unique keys leave.
    """
    names = ["row_key", "start", "count", "lead", "key", "salts"]
    for table, firsts, times, mixed, others in ranked_rows(batches):
        done, more = np.concatenate([others, firsts[times != 1]]), (times > 0) & mixed
        at = np.concatenate([done, firsts[more]])
        state = np.concatenate([np.full(len(done), DONE), np.where(times[more] == 1, LONE, WITNESS)])
        if len(at):
            some = table.select(names).take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(some.column(n).combine_chunks() for n in names), pa.array(state.astype(np.int8))], names=[*names, "state"])


NEXT = "row_key long, start int, count short, lead short, key long, salts int, salt long, whole long, weight byte, crowded boolean, lone boolean, raw binary"


class Grown:
    """Rows of the next round: each run cut into blocks of windows, ranked over the bytes that all of a block hold.

    The leads of a block (how far its windows start before their anchor) are those with the same quotient by ``size``.
    The smaller the blocks, the longer the string around the anchor that all their windows hold. Its key is the
    rank of a pair: the key of the round before, and the bytes by which the string has grown.
    """

    def __init__(self, length: int, size: int, before: int):
        self.length, self.size, self.before, self.reach = length, size, before, length - length // 2
        self.out: list[list] = [[] for _ in range(12)]

    def block(self, lead: int, size: int) -> tuple[int, int]:
        low = lead // size * size
        return low, min(low + size - 1, self.reach)

    def add(self, row: int, start: int, count: int, lead: int, key: int, salts: int, lone: bool, raw: bytes) -> None:
        out, least, length = self.out, lead - count + 1, self.length
        high = lead
        while high >= least:
            low, top = self.block(high, self.size)
            was_low, was_top = self.block(high, self.before)
            end = max(least, low)
            piece = raw[lead - high : lead - end + length]
            grown = raw[lead - low : lead - was_low] + raw[lead - was_top + length : lead - top + length]
            whole = xxhash.xxh3_64_intdigest(piece, seed=high + 1)
            rank = xxhash.xxh3_64_intdigest(grown, seed=(key ^ (low * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF)
            values = (row, start + lead - high, high - end + 1, high, rank, salts, whole % salts, whole, 1, salts > 1, lone, piece if self.size > 1 else None)
            for column, v in zip(out, values):
                column.append(v)
            high = end - 1

    def pass_on(self, row: int, start: int, count: int) -> None:
        """A run already decided: it goes on under a key of its own."""
        for column, v in zip(self.out, (row, start, count, 0, (row * 1_000_003 + start) & 0xFFFFFFFFFFFFFFFF, 1, 0, 0, 0, False, False, None)):
            column.append(v)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """What has gathered, if ``least`` rows or more."""
        if len(self.out[0]) < least:
            return
        row, start, count, lead, key, salts, salt, whole, weight, crowded, lone, raw = self.out
        self.out = [[] for _ in range(12)]
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        columns = [pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int16()), pa.array(lead, pa.int16()), signed(key), pa.array(salts, pa.int32()), pa.array(salt, pa.int64()), signed(whole)]
        columns += [pa.array(weight, pa.int8()), pa.array(crowded, pa.bool_()), pa.array(lone, pa.bool_()), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in NEXT.split(", ")])


def _opened(length: int, size: int):
    """The runs of each row that are still open, with their bytes, as rows of the next round."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = Grown(length, size, 1 << 15)
        for batch in batches:
            for doc, raw, runs in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), batch.column(2)):
                for r in runs.as_py():
                    s, c = r["start"], r["count"]
                    grown.add(doc, s, c, r["lead"], r["key"], r["salts"], r["lone"], raw[s : s + c + length - 1])
                yield from grown.batches(8192)
        yield from grown.batches()

    return rows


def _next_ranks(length: int, size: int, before: int):
    """One round: runs that repeat as a whole are decided, unique keys leave, the rest is cut into blocks of ``size``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = Grown(length, size, before)
        names = ["row_key", "start", "count", "lead", "key", "salts", "lone", "raw"]
        for table, firsts, times, mixed, others in ranked_rows(batches):
            row, start, count, lead, key, salts, lone = (table.column(n).to_numpy() for n in names[:-1])
            weight, raw = table.column("weight").to_numpy(), table.column("raw")
            repeats = np.concatenate([others, firsts[times > 1]])
            done = np.concatenate([repeats[lone[repeats]], firsts[weight[firsts] == 0]])
            for i in done.tolist():
                grown.pass_on(int(row[i]), int(start[i]), int(count[i]))
            if size:
                for i, t in zip(firsts[(times > 0) & mixed].tolist(), times[(times > 0) & mixed].tolist()):
                    grown.add(int(row[i]), int(start[i]), int(count[i]), int(lead[i]), int(key[i]), int(salts[i]), bool(lone[i]) and t == 1, raw[i].as_py())
            yield from grown.batches(8192)
        yield from grown.batches()

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies the spans: what is removed, and what stays."""
    for batch in batches:
        spans, kept, removed, sizes = [], [], [], []
        for raw, found in zip(utf8_rows(batch.column(1)), batch.column(2)):
            merged = merged_spans(found.values.field("start").to_numpy(), found.values.field("end").to_numpy()) if found.is_valid and len(found.values) else []
            at, rest = 0, []
            for s, e in merged:
                rest.append(raw[at:s])
                at = e
            rest.append(raw[at:])
            kept.append(b"".join(rest))
            spans.append([{"start": s, "end": e} for s, e in merged])
            removed.append(sum(e - s for s, e in merged))
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "spans", "kept"],
        )


def merged_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as maximal runs in order; touching spans are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[new].tolist(), reach[np.append(new[1:] - 1, len(reach) - 1)].tolist()))


def block_sizes(length: int) -> list[int]:
    """Windows a block in each round: powers of two from the largest a run can fill to eight, then single windows."""
    size = 1 << ((length - length // 2).bit_length() - 1)
    return [size >> k for k in range(size.bit_length()) if size >> k >= 8] + [1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group_rows: int = 256, hot_keys: int = 4096) -> DataFrame:
    """Each row's id with n_bytes, n_removed, spans (removed runs) and kept (the bytes that stay).

    A byte goes if a string of ``length`` bytes (even, 2 to 30,000) that covers it also starts anywhere else in the
    corpus, the same text included. Texts are UTF-8 bytes; strings never cross rows and are judged on the input.

    Prefix doubling over positions sampled by content: every window of ``length`` holds one anchor, whose half-length
    string is the window's least by hash, so equal windows share it. Rows are runs of windows with one anchor. In each
    round Spark sorts them by rank; unique ranks leave, runs whose bytes all repeat are decided, and the others are cut
    into halves and ranked again by the pair of their rank and of the bytes by which the string grows: from half the
    length around the anchor, the part still missing halves each round, until it is single windows of the whole ``length``.

    Runs that repeat within a batch are counted before the shuffle. Keys with over a ``hot_keys``-th of all rows (so
    fewer than that many; and over ``group_rows``) are split by their runs' bytes, eight parts for as many rows; these do not leave
    early, but equal windows still meet. No task holds a key's rows: the pass over the sorted rows keeps one.

    Null text is empty: nothing removed. Texts shorter than ``length`` stay whole. Repeated rows are each other's
    copies. An empty table gives no rows. Null ids are kept as ids. Other columns are ignored.
    """
    # Keys are never null; saying so keeps both joins below on one shuffle of the texts.
    rows = keyed_rows(docs, id_col, text_col).where("row_key is not null").select(id_col, "row_key", text_col)
    texts = rows.select("row_key", text_col)
    counts = written(texts.mapInArrow(_frequent(length, hot_keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("key is null").agg(F.max("n")).first()[0] or 0
    most = max(group_rows, total // hot_keys)
    hot = counts.where((F.col("key").isNotNull()) & (F.col("n") > most)).select("key", F.ceil(F.lit(8) * F.col("n") / F.lit(most)).cast("int").alias("salts"))
    runs = texts.mapInArrow(_segments(length), "row_key long, start int, count short, lead short, key long, whole long, weight byte")
    runs = runs.join(F.broadcast(hot), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    runs = runs.withColumn("salt", F.pmod("whole", "salts")).withColumn("crowded", F.col("salts") > 1)
    judged = written(runs.repartition("key", "salt").sortWithinPartitions("key", "salt", "whole").mapInArrow(_first_ranks, FIRST), "runs")
    decided = judged.where(F.col("state") == DONE).select("row_key", "start", "count")
    lone = (F.col("state") == LONE).alias("lone")
    open_runs = judged.where(F.col("state") != DONE).groupBy("row_key").agg(F.collect_list(F.struct("start", "count", "lead", "key", "salts", lone)).alias("runs"))
    sizes = block_sizes(length)
    # Always by a merge join: the runs grow with the corpus, so a plan for small ones would tell nothing of large ones.
    now = rows.join(written(open_runs, "open").hint("merge"), "row_key").select("row_key", text_col, "runs", id_col).mapInArrow(_opened(length, sizes[0]), NEXT)
    for before, size in zip(sizes, [*sizes[1:], 0]):
        now = now.repartition("key", "salt").sortWithinPartitions("key", "salt", "whole").mapInArrow(_next_ranks(length, size, before), NEXT)
    spans = decided.unionByName(now.select("row_key", "start", "count"))
    spans = spans.select("row_key", F.struct("start", (F.col("start") + F.col("count") + F.lit(length - 1)).cast("int").alias("end")).alias("span"))
    per_row = spans.groupBy("row_key").agg(F.collect_list("span").alias("found"))
    kind = dict(docs.dtypes)[id_col]
    return rows.join(per_row.hint("merge"), "row_key", "left").select(F.col(id_col), text_col, "found").mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start long, end long>>, kept binary").withColumnRenamed("id", id_col)
