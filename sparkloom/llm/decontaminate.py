"""Operator 2: benchmark passages in documents, by spaced-seed hashing and substitution-tolerant overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.arrays import group_starts, sliced
from sparkloom.llm.shared import keyed_rows, small_side, written

# Any overlap of five tokens or more with at most a fifth substituted holds one of these, whatever was substituted.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
_words = re.compile(r"\w+").findall
_odd = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class Tokens:
    """Hashes of the lower-cased words (letters, digits, underscores) of a text."""

    def __init__(self, memory: int = 200_000):
        self.known: dict[str, int] = {}
        self.memory = memory

    def __call__(self, text: str) -> np.ndarray:
        words = _words(text.lower())
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.memory:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """A hash for each place of the mask: the tokens it keeps, each by its place, and the mask's number."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(number + 1) * np.uint64(0x2545F4914F6CDD1D))
    for k, at in enumerate(mask):
        h += tokens[at : at + n] * np.uint64(_odd[k % len(_odd)] + 2 * (k // len(_odd)))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _probes(h: np.ndarray, bits: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    return tuple(((x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63))) for x in (h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)))


def contexts(tokens: np.ndarray, at: np.ndarray, min_tokens: int, pad: int) -> np.ndarray:
    """Sixteen bits of each token around each seed, as far as an overlap of under twice ``min_tokens`` that holds it can reach."""
    left, right = 2 * min_tokens - 1 - 5, 2 * min_tokens - 1
    around = np.concatenate([np.full(left, pad, np.uint16), tokens.astype(np.uint16), np.full(right, pad, np.uint16)])
    return np.lib.stride_tricks.sliding_window_view(around, left + right)[at]


def _contexts_column(around: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(around.shape[1] * 2), len(around), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())


def _test_seeds(min_item: int, min_tokens: int, similarity: float):
    """A row for each seed of an item: where it is, what is around it, and how many equal tokens there an overlap needs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = tokens(text or "")
                if len(t) < min_item:
                    continue
                need = int(np.ceil(similarity * min(len(t), min_tokens) - 1e-9))
                for number, mask in enumerate(MASKS):
                    h = seeds(t, mask, number)
                    for k in range(0, len(h), 4096):
                        at = np.arange(k, min(k + 4096, len(h)))
                        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), item, np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), need, np.int32)), _contexts_column(contexts(t, at, min_tokens, 1))], names=["hash", "who", "pos", "need", "around"])

    return rows


def _filter_words(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, bit in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bit"])

    return rows


def seeds_of_many(tokens: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, its places within single documents and their hashes; ``doc`` numbers each token's document."""
    by_place = [tokens * np.uint64(odd) for odd in _odd[:4]]
    for number, mask in enumerate(MASKS):
        n = len(tokens) - mask[-1]
        if n <= 0:
            continue
        h = sum((by_place[k][at : at + n] for k, at in enumerate(mask)), np.uint64(number + 1) * np.uint64(0x2545F4914F6CDD1D))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        yield np.flatnonzero(doc[:n] == doc[mask[-1] :]), h


def _hits(words: np.ndarray, filled: np.ndarray, bits: int, min_tokens: int, at_once: int = 1 << 16):
    """Seeds of documents that the filter of test seeds lets through, with the tokens around them.

    Documents are handled some at a time. So what is around a seed near an end may belong to another: that can only let a
    diagonal pass that the whole texts then refute.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words] = filled
        tokens = Tokens()

        def hits(keys: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(t) for t in found])
            every, first = np.concatenate(found), np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
            for place, h in seeds_of_many(every, doc):
                (word, bit), second = _probes(h, bits)
                at = place[((table[word] & bit) != 0)[place]]
                at = at[(table[second[0][at]] & second[1][at]) != 0]
                for k in range(0, len(at), 4096):
                    some = at[k : k + 4096]
                    mine = doc[some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[some].view(np.int64)), pa.array(np.array(keys, np.int64)[mine]), pa.array((some - first[mine]).astype(np.int32)), _contexts_column(contexts(every, some, min_tokens, 0))], names=["hash", "who", "pos", "around"]
                    )

        for batch in sliced(batches):
            keys, found, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    keys.append(key)
                    found.append(tokens(text))
                    size += len(found[-1])
                if size >= at_once:
                    yield from hits(keys, found)
                    keys, found, size = [], [], 0
            if found:
                yield from hits(keys, found)

    return rows


def _met(min_tokens: int):
    """Diagonals of hits that can belong to an overlap, from rows sorted by hash, salt, part and kind.

    The test seeds of a meeting (kind 0, a bounded part) come first and are kept; hits stream past them. Some stretch of
    an overlap, of under twice the least length, is as similar as the whole and holds a hit; so around that hit at least
    the tokens that the least overlap needs are equal. Hits without are by chance, however common the phrase.
    """
    width = 2 * (2 * min_tokens - 1) - 5

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, need, shifts, tests = None, None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("hash", "salt", "part")]
            who, pos, kind, needs = (batch.column(c).to_numpy() for c in ("who", "pos", "kind", "need"))
            column = batch.column("around").cast(pa.large_binary())
            at = int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
            around = np.frombuffer(column.buffers()[2], np.uint16, batch.num_rows * width, at).reshape(-1, width)
            starts = np.append(group_starts([*keys, kind]), batch.num_rows)
            rows_out, items_out, shifts_out = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                group = tuple(int(k[a]) for k in keys)
                if group != now:
                    now, tests, items = group, [], None
                if kind[a] == 0:
                    tests.append((who[a:b].copy(), pos[a:b].copy(), needs[a:b].copy(), around[a:b].copy()))
                    items = None
                    continue
                if not tests:
                    continue
                if items is None:
                    items, shifts, need, facing = (np.concatenate(x) for x in zip(*tests))
                step = max(1, (1 << 21) // facing.size)
                for k in range(a, b, step):
                    some = slice(k, min(k + step, b))
                    i, j = np.nonzero((around[some, None] == facing[None]).sum(axis=2) >= need)
                    rows_out.append(who[some][i])
                    items_out.append(items[j])
                    shifts_out.append(pos[some][i] - shifts[j])
            if rows_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows_out, items_out, shifts_out)], names=["row_key", "item_key", "shift"])

    return rows


def diagonals(hits: DataFrame, test: DataFrame, min_tokens: int, group_rows: int = 4096, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(row_key, item_key, shift) of all ``hits`` that face a seed of ``test`` and can belong to an overlap.

    Hashes with over ``group_rows`` hits or test seeds are split: hits by their document into salts, which all get the
    test seeds, and test seeds by their item into parts, which all get the hits. So a phrase common to many documents
    and items is compared in many tasks, and only what it may be a part of leaves them.
    """
    n_hits, n_tests = (x.groupBy("hash").agg(F.count("*").alias(n)) for x, n in ((hits, "n_hits"), (test, "n_tests")))
    n_tests = n_tests.join(n_hits, "hash", "left_semi")
    cut = lambda n: F.ceil(F.col(n) / F.lit(group_rows)).cast("int")
    large = written(n_hits.join(n_tests, "hash").where((F.col("n_hits") > group_rows) | (F.col("n_tests") > group_rows)).select("hash", cut("n_hits").alias("salts"), cut("n_tests").alias("parts")), "hot")
    large = small_side(large, broadcast_bytes)
    one = F.lit(1)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), one) - 1))
    own = lambda n: F.pmod(F.xxhash64("who"), F.coalesce(F.col(n), one)).cast("int")
    columns = ["hash", "salt", "part", "kind", "who", "pos", "need", "around"]
    tests = test.join(large, "hash", "left").withColumn("part", own("parts")).withColumn("salt", upto("salts")).withColumn("kind", F.lit(0)).select(columns)
    docs = hits.join(large, "hash", "left").withColumn("salt", own("salts")).withColumn("part", upto("parts")).withColumn("kind", F.lit(1)).withColumn("need", F.lit(0)).select(columns)
    met = tests.unionByName(docs).repartition("hash", "salt", "part").sortWithinPartitions("hash", "salt", "part", "kind")
    return met.mapInArrow(_met(min_tokens), "row_key long, item_key long, shift int")


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, similarity: float) -> tuple[int, int, int, int]:
    """(tokens, matches, start in doc, start in item) of the longest overlap on a diagonal that is similar enough.

    doc[i + shift] faces item[i]. The overlap starts and ends with a match; of equally long ones the first counts.
    """
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b <= a:
        return (0, 0, 0, 0)
    match = doc[a + shift : b + shift] == item[a:b]
    at = np.flatnonzero(match)
    if not len(at):
        return (0, 0, 0, 0)
    # A span from match i to match j has j - i + 1 matches: similar enough if gain[j] + 1 - similarity >= gain[i].
    nth = np.arange(len(at))
    gain = nth - similarity * at
    top = np.maximum.accumulate(gain[::-1])[::-1] + 1 - similarity + 1e-9
    best = (0, 0, 0, 0)
    j = 0
    lowest = np.inf
    for i in range(len(at)):
        if gain[i] >= lowest:
            continue  # an earlier start does as well
        lowest = gain[i]
        j = max(j, i)
        while j < len(at) and top[j] >= gain[i]:
            j += 1
        span = int(at[j - 1] - at[i] + 1) if j > i else 0
        if span > best[0]:
            best = (span, j - i, int(at[i] + a + shift), int(at[i] + a))
    return best


def _verified(similarity: float, min_tokens: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in sliced(batches):
            out = []
            for who, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                doc = tokens(text)
                items: dict[int, tuple] = {}
                for hit in found:
                    item = tokens(hit["text"])
                    need = min(len(item), min_tokens)
                    for shift in hit["shifts"]:
                        n, m, at, of = best_overlap(doc, item, shift, similarity)
                        if n >= need or n and len(item) <= min_tokens and m >= similarity * len(item):
                            this = (n, m, -at, -of)
                            if hit["item_key"] not in items or this > items[hit["item_key"]][0]:
                                items[hit["item_key"]] = (this, hit["item"])
                out += [{"id": who, "item": item, "n_tokens": n, "n_matches": m, "doc_start": -at, "item_start": -of} for (n, m, at, of), item in items.values()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", batch.column(0).type), ("item", batch.column(2).type.value_type.field("item").type), ("n_tokens", pa.int32()), ("n_matches", pa.int32()), ("doc_start", pa.int32()), ("item_start", pa.int32())]))

    return rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, min_tokens: int = 12, min_item: int = 5, max_filter_bits: int = 28, group_rows: int = 4096, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """A row for each document and benchmark item that overlap: id, item, n_tokens, n_matches, doc_start, item_start.

    Tokens are lower-cased words. An overlap is an aligned run of tokens, substitutions allowed, insertions not, with
    at least ``similarity`` of its tokens equal and ``min_tokens`` long; items with fewer tokens have to overlap whole.
    Items of fewer than ``min_item`` tokens, null or empty ones never match. The longest overlap of a pair is given.

    Spaced seeds: hashes of the tokens that four fixed masks keep. A bit filter of sixteen bits a test seed, and of
    2 ** ``max_filter_bits`` (32 MB) at most, goes to all tasks; seeds of documents that pass it join the test seeds by
    hash, so a fuller filter costs rows, never results. Where they meet, the tokens around them decide which diagonals can
    hold an overlap (``diagonals``, which splits hot seeds), and these are verified against the whole text. Candidates go
    to the documents by broadcast if their rows are small, else by a join.
    Null and empty texts have no rows; rows that repeat an id give one for each different text; empty tables give none.
    """
    items = keyed_rows(benchmark, item_col, item_text_col, key="item_key").select("item_key", F.col(item_col).alias("item"), F.col(item_text_col).alias("item_text"))
    items = written(items.where("item_text is not null").dropDuplicates(["item_key"]), "items")
    test = written(items.select("item_key", "item_text").mapInArrow(_test_seeds(min_item, min_tokens, similarity), "hash long, who long, pos int, need int, around binary"), "seeds")
    filter_bits = min(max_filter_bits, max(20, (16 * test.count()).bit_length()))
    bits = test.select("hash").mapInArrow(_filter_words(filter_bits), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words, filled = bits.column("word").to_numpy(), bits.column("bits").to_numpy().view(np.uint64)
    rows = keyed_rows(docs, id_col, text_col)
    hits = written(rows.select("row_key", text_col).mapInArrow(_hits(words, filled, filter_bits, min_tokens), "hash long, who long, pos int, around binary"), "seed_hits")
    near = diagonals(hits, test, min_tokens, group_rows, broadcast_bytes).groupBy("row_key", "item_key").agg(F.collect_set("shift").alias("shifts"))
    found = near.join(items, "item_key").groupBy("row_key").agg(F.collect_list(F.struct("item_key", "item", F.col("item_text").alias("text"), "shifts")).alias("found"))
    found = small_side(written(found, "hits"), broadcast_bytes)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    near = rows.join(found, "row_key").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "found")
    out = near.mapInArrow(_verified(similarity, min_tokens), f"id {kind}, item {item_kind}, n_tokens int, n_matches int, doc_start int, item_start int")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_tokens", "n_matches", "doc_start", "item_start")
