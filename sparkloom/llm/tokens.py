"""Operator 6: token counts, with overlapping chunks spliced where both encodings provably agree."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WHITE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space, a fixed value


class Counter:
    """Token counts by a ``tokenizers`` file whose words never hold white space behind a non-space.

    That holds for byte-level BPE with its own word pattern, which is checked: a piece (white space, then no white
    space) is then a sequence of whole words whatever stands around it, so its count is looked up once per text.
    """

    def __init__(self, path: str, memory: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        words = parts.get("pre_tokenizer") or {}
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall if words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space") and not parts.get("normalizer") and not any(re.search(f"[{WHITE}]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts.get("added_tokens", [])) else None
        self.known: dict[str, int] = {}
        self.memory = memory

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count_short(self, texts: list[str]) -> list[int]:
        if self.pieces is None:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known, cut = self.known, [self.pieces(t) for t in texts]
        new = list({p for found in cut for p in found if p not in known})
        if len(known) + len(new) > self.memory:
            known.clear()
            new = list({p for found in cut for p in found})
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            known.update(zip(some, (len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        return [sum(map(known.__getitem__, found)) for found in cut]

    def word_starts(self, encoding) -> dict[int, int]:
        """Places where a word starts, each with the number of tokens before it."""
        starts: dict[int, int] = {}
        word = None
        for k, (w, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
            if w is None or w != word:
                starts.setdefault(a, k)
            word = w
        return starts

    def count_huge(self, text: str, chunk: int, overlap: int) -> int:
        """Chunks overlap; two meet at the last place in the overlap where a word starts in both encodings.

        The word pattern reads left to right and looks ahead one character at most, so the words of a chunk that starts
        at a true boundary are true but for those at its end, and a chunk's words are true from the first true boundary
        on. The place has to keep clear of the earlier chunk's last words. Without one, the overlap is doubled; a text
        without any boundary ends up in one piece.
        """
        n, total, begin, before, true_from = len(text), 0, 0, 0, 0  # before: tokens of ``now`` before true_from
        end = min(chunk, n)
        now = self.encode(text[:end])
        while end < n:
            starts, span = self.word_starts(now), overlap
            clear = [begin + s for s in sorted(starts)[:-2] if begin + s >= true_from]
            while True:
                at = max(begin, end - span)
                until = min(n, at + max(chunk, 2 * span))
                there = self.encode(text[at:until])
                theirs = self.word_starts(there)
                meet = next((p for p in reversed(clear) if p > at and p - at in theirs), None)
                if meet is not None or at == begin:
                    break
                span *= 2
            if meet is not None:
                total += starts[meet - begin] - before
                now, begin, end, before, true_from = there, at, until, theirs[meet - at], meet
            else:
                chunk *= 2
                end = min(n, begin + chunk)
                now = self.encode(text[begin:end])
        return total + len(now.ids) - before


def _counted(path: str, huge: int, chunk: int, overlap: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= huge]
            for k in range(0, len(short), 256):
                out[short[k : k + 256]] = counter.count_short([texts[i] for i in short[k : k + 256]])
            for i, t in enumerate(texts):
                if len(t) > huge:
                    out[i] = counter.count_huge(t, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], names=["id", "n_bytes", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, huge: int = 65536, chunk: int = 16384, overlap: int = 512) -> DataFrame:
    """The id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    Counts are those of the ``tokenizers`` library for the file at ``tokenizer_path``, without added special tokens,
    truncation or padding; special strings in texts are read as the library does by default. Texts over ``huge``
    characters are encoded in overlapping chunks (see ``Counter.count_huge``), so memory stays bounded unless a text
    has no boundary at all. Null text is empty. Nothing is shuffled; repeated and null ids are kept; empty tables give
    no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(_counted(tokenizer_path, huge, chunk, overlap), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
