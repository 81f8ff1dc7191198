"""Providers as functions over batches: embeddings and the judge. Failure is data, and keys travel with their rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], list[list[float]]]
Judge = Callable[[str, str], tuple[bool, str]]


def embedded(rows: DataFrame, text_col: str, embed: Embedder, out: str = "embedding", batch: int = 128, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """``rows`` with a vector for each text: null for null or empty texts, and where the provider failed ``tries`` times."""
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n != out) + f", `{out}` array<float>"
    columns = [c for c in rows.columns if c != out]

    def ask(texts: list[str]) -> list[list[float] | None]:
        for n in range(tries):
            try:
                return list(embed(texts))
            except Exception:  # a provider's failure is data
                if n + 1 < tries:
                    time.sleep(wait)
        return [None] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found: list = [None] * len(rows)
            wanted = [i for i, t in enumerate(rows[text_col]) if t]
            for k in range(0, len(wanted), batch):
                at = wanted[k : k + batch]
                for i, v in zip(at, ask([rows[text_col].iloc[i] for i in at])):
                    found[i] = v
            yield rows.assign(**{out: found})

    return rows.select(*columns).mapInPandas(run, schema)


def judged_pairs(pairs: DataFrame, judge: Judge, concern: str = "concern", body: str = "body") -> DataFrame:
    """``pairs`` with same_concern and judge_reason; a failing judge says no, with the reason judge_error."""
    schema = ", ".join(f"`{n}` {k}" for n, k in pairs.dtypes) + ", same_concern boolean, judge_reason string"

    def one(a, b) -> tuple[bool, str]:
        try:
            same, reason = judge(a, b)
            return bool(same), reason
        except Exception as error:  # a provider's failure is data
            return False, f"judge_error: {error}"[:2000]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [one(a, b) for a, b in zip(rows[concern], rows[body])]
            yield rows.assign(same_concern=[g[0] for g in got], judge_reason=[g[1] for g in got])

    return pairs.mapInPandas(run, schema)


def hashed_words(dims: int = 64) -> Embedder:
    """A deterministic stand-in: unit vectors of hashed words."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed
