"""Operator 12: packing by minimum bin slack, planned on counts of lengths and carried out by ranks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.llm.arrays import sliced
from sparkloom.llm.byte_bpe import byte_encoder
from sparkloom.llm.shared import keyed_rows, small_side, written

FIELDS = ("length", "first", "sequence", "copies", "offset", "take", "tail")


def closest_fill(left: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of ``left`` (length: count) whose sum is nearest to ``target`` from below: subset sums as the bits of a
    number, long pieces first, and the counts found by going back through the steps."""
    bits, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted((x for x in left if x <= target), reverse=True):
        count, some = min(left[length], target // length), 1
        while count > 0 and not bits >> target:
            some = min(some, count)
            more = (bits | bits << (some * length)) & mask
            if more != bits:
                steps.append((length, some, bits))
                bits = more
            count -= some
            some *= 2
        if bits >> target:
            break
    at, picked = bits.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + some
            at -= some * length
    return picked


def plan_windows(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Which pieces go where: rows of FIELDS sorted by length and first, and the number of sequences.

    ``counts`` has the pieces of each length under ``capacity``. Each step takes the longest piece left and the multiset that fills
    the rest of a window best, and repeats that window as often as the counts allow. Where it leaves slack, one more piece is
    cut to close it; the tail is a piece again. What is left in the end fills sequences of powers of two.

    A row says: the pieces of ``length`` with ranks from ``first`` on go, ``copies`` to a sequence, to ``sequence`` and those after
    it, side by side from ``offset`` on. If ``take`` is less than the length, only so many ids of each do, and the rest is the piece
    of rank ``tail`` on of its own length. A step uses up a length or adds a full window of what the steps before left over, so rows
    are bounded by the capacity, not by the number of pieces.
    """
    left = {k: v for k, v in counts.items() if v}
    total, used, rows, sequence = dict(left), dict.fromkeys(left, 0), [], 0

    def place(length: int, each: int, offset: int, times: int, take: int) -> None:
        tail = 0
        if take < length:
            rest = length - take
            tail = total.get(rest, 0)
            total[rest] = tail + times
            left[rest] = left.get(rest, 0) + times
            used.setdefault(rest, 0)
        rows.append((length, used[length], sequence, each, offset, take, tail))
        used[length] += each * times
        left[length] -= each * times
        if not left[length]:
            del left[length]

    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items()}
        need = closest_fill(rest, capacity - longest)
        need[longest] = need.get(longest, 0) + 1
        slack = capacity - sum(k * v for k, v in need.items())
        more = max((k for k, v in left.items() if v > need.get(k, 0)), default=0)
        if slack and not more:
            break
        uses = need | ({more: need.get(more, 0) + 1} if slack else {})
        times, offset = min(left[k] // v for k, v in uses.items()), 0
        for length, each in sorted(need.items(), reverse=True):
            place(length, each, offset, times, length)
            offset += each * length
        if slack:
            place(more, 1, offset, times, slack)
        sequence += times
    ends = sum(k * v for k, v in left.items())
    for power in (1 << b for b in reversed(range(ends.bit_length())) if ends >> b & 1):
        offset = 0
        while offset < power:
            length = max(left)
            take = min(length, power - offset)
            place(length, 1, offset, 1, take)
            offset += take
        sequence += 1
    plan = np.array(sorted(rows), np.int64).reshape(-1, len(FIELDS))
    return plan, sequence


def _cut(path: str, capacity: int, end_id: int):
    """Runs of pieces of one length: all full ones of a document, and its rest; ``nth`` counts those before it in this partition."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = byte_encoder(path), TaskContext.get().partitionId(), {}
        for batch in sliced(batches, 256):
            at, start, length, times, nth, crcs, tokens = [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(2)):
                ids = encoder.ids(value.as_py() or "").tobytes() + end
                n = len(ids) // 4
                full, rest = divmod(n, capacity)
                for size, many, begin in ((capacity, full, 0), (rest, 1, full * capacity)):
                    if size and many:
                        at.append(i), start.append(begin), length.append(size), times.append(many), nth.append(seen.get(size, 0)), tokens.append(n)
                        crcs.append([zlib.crc32(ids[k : k + step]) for k in range(4 * begin, 4 * (begin + size * many), step)])
                        seen[size] = seen.get(size, 0) + many
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([part] * len(at), pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, times, nth, tokens)), pa.array(crcs, pa.list_(pa.int64()))],
                names=["id", "row_key", "part", "start", "length", "times", "nth", "tokens", "crcs"],
            )

    return rows


def _placed(plan, sequences: int, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        stride = 1 << 48
        keys = table[:, 0] * stride + table[:, 1]
        for batch in sliced(batches, 4096):
            start, length, times, rank, tokens = (batch.column(k).to_numpy() for k in range(2, 7))
            crcs = batch.column(7)
            crc = crcs.flatten().to_numpy()
            out = []
            full = np.flatnonzero(length == capacity)
            at = full.repeat(times[full])
            inner = np.arange(len(at)) - (np.cumsum(times[full]) - times[full]).repeat(times[full])
            place = np.append(0, np.cumsum(times))[:-1]  # of each row's first checksum: one a piece
            out.append((at, start[at] + inner * capacity, np.full(len(at), capacity), crc[place[at] + inner], np.ones(len(at), bool), sequences + rank[at] + inner, np.zeros(len(at), np.int64)))
            at = np.flatnonzero(length < capacity)
            begin, size, nth, whole = start[at], length[at], rank[at], np.ones(len(at), bool)
            while len(at):
                row = table[np.searchsorted(keys, size * stride + nth, "right") - 1]
                q = nth - row[:, 1]
                take = row[:, 5]
                out.append((at, begin, take, crc[place[at]], whole & (take == size), row[:, 2] + q // row[:, 3], row[:, 4] + q % row[:, 3] * take))
                more = take < size
                at, begin, size, nth, whole = at[more], (begin + take)[more], (size - take)[more], (row[:, 6] + q)[more], np.zeros(int(more.sum()), bool)
            at, begin, take, crc, known, sequence, offset = (np.concatenate(c) for c in zip(*out))
            index = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(begin), pa.array(take), pa.array(crc, mask=~known), pa.array(tokens[at]), pa.array(sequence), pa.array(offset)],
                names=["id", "row_key", "start", "length", "crc", "tokens", "sequence", "offset"],
            )

    return rows


def _recut(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        for batch in sliced(batches, 64):
            out = []
            for key, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = encoder.ids(text or "").tobytes() + end
                out += [(key, c["start"], c["length"], zlib.crc32(ids[4 * c["start"] : 4 * (c["start"] + c["length"])])) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["row_key", "start", "length", "crc"])

    return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text and ``end_id``; its full windows of ``capacity`` ids are sequences of their own, the rest
    is a piece. Windows are planned by minimum bin slack on the counts of piece lengths alone (``plan_windows``), at most
    ``capacity`` rows in the driver. A piece's place follows from its rank among those of its length: its number in its partition,
    written with it, and the sum of the counts of the partitions before. So no length is gathered in one task, however many
    pieces have it. Sequences are full but for the last ones, whose sizes are powers of two and sum to what is left: nothing is padded.

    Texts are encoded once; the few that the plan cuts inside their rest are encoded again for the checksums of the parts. Text
    without white space is encoded in one go, so memory grows with the longest such run. Planning takes some
    seconds at 2,048 and grows with the cube of ``capacity``.

    A null or empty text is ``end_id`` alone. Null ids are kept. Repeated rows are packed each. Empty tables give no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = keyed_rows(docs, id_col, text_col).select(F.col(id_col).alias("id"), "row_key", F.col(text_col).alias("text"))
    schema = f"id {kind}, row_key long, part int, start long, length long, times long, nth long, tokens long, crcs array<long>"
    runs = written(rows.mapInArrow(_cut(tokenizer_path, capacity, end_id), schema), "runs")
    counts = runs.groupBy("part", "length").agg(F.sum("times").alias("n"))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sizes.pop(capacity, None)
    plan, sequences = plan_windows(sizes, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = runs.join(before, ["part", "length"]).select("id", "row_key", "start", "length", "times", (F.col("before") + F.col("nth")).alias("rank"), "tokens", "crcs")
    schema = f"id {kind}, row_key long, start long, length long, crc long, tokens long, sequence long, offset long"
    placed = written(ranked.mapInArrow(_placed(spark.sparkContext.broadcast(plan), sequences, capacity), schema), "placed")
    parts = placed.where("crc is null").groupBy("row_key").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))
    again = rows.join(small_side(written(parts, "cuts"), broadcast_bytes), "row_key").dropDuplicates(["row_key"]).select("row_key", "text", "cuts")
    sums = again.mapInArrow(_recut(tokenizer_path, end_id), "row_key long, start long, length long, crc long")
    known = placed.where("crc is not null")
    found = placed.where("crc is null").drop("crc").join(sums, ["row_key", "start", "length"])
    return known.unionByName(found).select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
