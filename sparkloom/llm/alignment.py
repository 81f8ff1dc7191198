"""Operator 11: which tokens of two tokenizers cover the same bytes, and how often they meet over a corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.llm.arrays import sliced, unite
from sparkloom.llm.byte_bpe import byte_encoder, byte_of_character
from sparkloom.llm.shared import written
from sparkloom.llm.texts import segments
from sparkloom.llm.tokens import WHITE

PART_CHARS = 1 << 20
PAIR_BITS = 20  # a pair is its first id shifted by these, and its second


class Aligner:
    """Tokens, groups and links of texts by a byte-level ``tokenizers`` file (A) and a ``sentencepiece`` model (B).

    Neither joins a non-space to a space behind it: A's words end there, and no piece of B holds a space there (checked). So a text is
    cut before each space that follows a non-space, and what a chunk gives is looked up. B puts a space before a text of its
    own, so it gets chunks without theirs.
    """

    def __init__(self, a_path: str, b_path: str, memory: int = 400_000):
        import sentencepiece

        self.a = byte_encoder(a_path, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_of_character()
        tokens = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = re.compile("<0x([0-9A-Fa-f]{2})>").fullmatch
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := single(p)) else p.replace("▁", " ").encode() for p in pieces]
        if max(len(tokens), len(pieces)) >= 1 << PAIR_BITS:
            raise ValueError(f"vocabularies of 2^{PAIR_BITS} tokens or more")
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.odd = re.compile(f"[{WHITE}] | $").search
        self.split = re.compile(f"(?<=[^{WHITE}]) (?=[{WHITE}]*[^{WHITE}])").split
        number = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.a_name, self.a_last = number(len(tokens), ","), number(len(tokens), "|")
        self.b_name, self.b_last = number(len(pieces), ","), number(len(pieces), ";")
        self.memory = memory
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good: list[bool] = []
        self.groups: list[str] = []
        self.sums = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.first = np.zeros(1, np.int64)  # of each chunk's pairs
        self.pairs = np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a space and ``text``, each without its leading space."""
        if not self.cuts:
            return [text]
        return self.split(text) if self.odd(" " + text) else text.split(" ")

    def encode(self, chunks: list[str]) -> tuple[list[bool], np.ndarray, np.ndarray]:
        """Which chunks both sides give back whole, and all their ids of A and of B. Chunks without white space at their ends are encoded
        side by side, 64 at a time, and again one by one if such a part does not come back."""
        plain = [not (c[:1].isspace() or c[-1:].isspace() or not c) for c in chunks]
        parts, k = [], 0
        while k < len(chunks):
            n = 1
            while plain[k] and n < 64 and k + n < len(chunks) and plain[k + n]:
                n += 1
            parts.append((k, n))
            k += n
        good, a_out, b_out = [True] * len(chunks), {}, {}
        while parts:
            texts = [" ".join(chunks[k : k + n]) for k, n in parts]
            again = []
            for (k, n), text, b in zip(parts, texts, self.b.encode(texts, num_threads=1)):
                a, raw = self.a.ids(" " + text).tolist(), b" " + text.encode()
                if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                    a_out[k], b_out[k] = a, b
                elif n > 1:
                    again += [(k + i, 1) for i in range(n)]
                else:
                    good[k] = False
            parts = again
        return good, *(np.fromiter((i for k in sorted(out) for i in out[k]), np.int64) for out in (a_out, b_out))

    def learn(self, chunks: list[str]) -> None:
        """Aligns chunks that are not known yet, all at once: they lie behind one another on one line of bytes."""
        good, a, b = self.encode(chunks)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        end = np.cumsum([len(c.encode()) + 1 if g else 0 for c, g in zip(chunks, good)])
        if len(a) and not (np.isin(end, np.append(a_end, 0)).all() and np.isin(end, np.append(b_end, 0)).all()):
            raise RuntimeError("a token crosses the end of a chunk")
        parent = np.arange(len(a) + len(b))
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_end, a_end, "left")  # the tokens of B that overlap each of A
        unite(parent, np.arange(len(a)), len(a) + low)
        unite(parent, np.searchsorted(a_end, b_start, "right"), len(a) + np.arange(len(b)))
        roots, of_a = np.unique(parent[: len(a)], return_inverse=True)  # a component's root is its first token of A
        of_b = np.searchsorted(roots, parent[len(a) :])
        wide = high - low + 1
        link_a = np.repeat(np.arange(len(a)), wide)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(wide) - wide, wide) + low[link_a]
        chunk_a, chunk_b = np.searchsorted(end, a_end), np.searchsorted(end, b_end)
        n_a, n_b, n_groups, n_links = (np.bincount(c, minlength=len(chunks)) for c in (chunk_a, chunk_b, chunk_a[roots], chunk_a[link_a]))
        words = np.empty(len(a) + len(b), object)
        last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        words[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = np.where(last_a, self.a_last[a], self.a_name[a])
        words[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = np.where(last_b, self.b_last[b], self.b_name[b])
        ends = np.cumsum(n_a + n_b).tolist()
        self.known.update(zip(chunks, range(len(self.good), len(self.good) + len(chunks))))
        self.good += good
        self.groups += ["".join(words[i:j])[:-1] for i, j in zip([0, *ends], ends)]
        self.sums = np.vstack([self.sums, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(n_links))
        self.pairs = np.append(self.pairs, a[link_a] << PAIR_BITS | b[link_b])

    def learn_all(self, lists: list[list[str]]) -> None:
        new = [c for c in dict.fromkeys(c for chunks in lists for c in chunks) if c not in self.known]
        if len(self.known) + len(new) > self.memory or len(self.pairs) > 16 * self.memory:
            self.forget()
            new = list(dict.fromkeys(c for chunks in lists for c in chunks))
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sums and digests of each text, and its different pairs with their numbers of links: offsets, pairs, numbers."""
        states = [_Sums() for _ in texts]
        waiting, room = [], PART_CHARS
        for state, text in zip(states, texts):
            for k, part in enumerate(segments(text) if text else ()):
                waiting.append((state, self.chunks(part[k > 0 :])))
                room -= len(part)
                if room < 0:
                    self.settle(waiting)
                    waiting, room = [], PART_CHARS
        self.settle(waiting)
        none = [np.zeros(0, np.int64)]
        found = [s.links() for s in states]
        offsets = np.append(0, np.cumsum([len(p) for p, _ in found]))
        return np.array([s.total for s in states]).reshape(-1, 4), [s.name() for s in states], offsets, np.concatenate([p for p, _ in found] or none), np.concatenate([t for _, t in found] or none)

    def settle(self, waiting: list[tuple[_Sums, list[str]]]) -> None:
        self.learn_all([chunks for _, chunks in waiting])
        for state, chunks in waiting:
            codes = list(map(self.known.__getitem__, chunks))
            if not all(map(self.good.__getitem__, codes)):
                state.good = False
            if state.good:
                code, often = np.unique(codes, return_counts=True)
                first, n = self.first[code], self.first[code + 1] - self.first[code]
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                state.add(";".join(map(self.groups.__getitem__, codes)), often @ self.sums[code], self.pairs[at], np.repeat(often, n))


class _Sums:
    """What the parts of one text add up to; nothing once a part is not given back."""

    def __init__(self):
        self.good, self.digest, self.counts, self.parts = True, None, np.zeros(4, np.int64), []

    def add(self, groups: str, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(groups.encode())
        self.counts = self.counts + counts
        pair, back = np.unique(pairs, return_inverse=True)
        self.parts.append((pair, np.bincount(back, weights=times, minlength=len(pair)).astype(np.int64)))

    @property
    def total(self) -> np.ndarray:
        return self.counts if self.good else np.zeros(4, np.int64)

    def name(self) -> str:
        return self.digest.hexdigest() if self.good and self.digest else ""

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.good or not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.parts) == 1:
            return self.parts[0]
        pair, back = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
        return pair, np.bincount(back, weights=np.concatenate([t for _, t in self.parts]), minlength=len(pair)).astype(np.int64)


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One for all tasks of a worker process."""
    return Aligner(a_path, b_path)


def _aligned(a_path: str, b_path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, seen = aligner_of(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in sliced(batches, 128):
            sums, digests, offsets, pairs, times = aligner.align(batch.column(1).to_pylist())
            both = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "times"])
            links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), both)
            row = pa.array(np.arange(seen, seen + batch.num_rows))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), row, *(pa.array(sums[:, k]) for k in range(4)), pa.array(digests), links], names=["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return rows


def with_counts(links: DataFrame, counts: DataFrame, broadcast_rows: int) -> DataFrame:
    """``links`` (row, pair, times) with the n and best of each pair in ``counts``.

    The pairs most documents hold go to the tasks, as many as ``broadcast_rows`` allow by whole powers of two of n; if that is all,
    nothing is shuffled. Any others are joined by a shuffle, and each of these is rarer than all that were sent.
    """
    power = F.floor(F.log2("n")).cast("int")
    by_power = counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()
    least, room = None, broadcast_rows
    for r in by_power:
        room -= r["count"]
        if room < 0:
            break
        least = r["power"]
    if least is None:
        return links.join(counts, "pair")
    hot = counts.where(power >= least)
    if room >= 0:
        return links.join(F.broadcast(hot), "pair")
    met = links.join(F.broadcast(hot), "pair", "left")
    rare = met.where("n is null").select(*links.columns).join(counts.where(power < least), "pair")
    return met.where("n is not null").unionByName(rare)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows of documents, and the pair counts they come from.

    Documents: id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair's count is the highest of its A id, ties
    included), count_sum (of counts over links), groups_sha256. Pairs: a, b, n (documents that hold the pair linked), best.

    A text with a space before it is encoded by both files, special strings as plain text. Tokens are nodes of a graph, overlapping
    ones joined; union-find gives its components, which are the least groups of both sides that cover the same bytes. The links
    of a component are the pairs of its members whose bytes overlap. Each document's different pairs are stored with their
    numbers of links; Spark counts the documents of each pair, with partial counts in each task, and joins counts back
    (``with_counts``), so frequent pairs meet in no one task.

    Null and empty texts, and those whose tokens of either side don't give back their bytes, have no tokens: zeros and an empty
    digest. Repeated rows and null ids are kept and counted each. Empty tables give no rows. Other columns are ignored.
    Texts are aligned in parts; a stretch without a space is aligned in one go.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:long>>"
    aligned = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_aligned(a_path, b_path), schema), "aligned")
    counted = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a = F.shiftright("pair", PAIR_BITS)
    counts = written(counted.withColumn("a", a).withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))).select("pair", "n", "best"), "paircounts")
    links = aligned.select("row", F.inline("links"))
    sums = with_counts(links, counts, broadcast_rows).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rows = aligned.drop("links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    documents = rows.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    return documents, counts.select(a.alias("a"), F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1).alias("b"), "n", "best")
