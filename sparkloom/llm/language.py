"""Operator 7: language by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.llm.arrays import sliced

DIMS = 4096
_letter = re.compile(r"[^\W\d_]").search
# ASCII letters lower-cased, other ASCII one blank, bytes of longer characters kept.
_table = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def features(text: str, at_once: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte trigrams and bigrams of the whole text, as a unit vector of square roots."""
    raw = _table[np.frombuffer(b" " + text.encode() + b" ", np.uint8)]
    out = np.zeros(DIMS)
    for k in range(0, len(raw), at_once):
        b = raw[max(0, k - 2) : k + at_once]
        two = b[:-1] * np.uint32(31) + b[1:]
        three = (two[:-1] * np.uint32(961) + b[2:] * np.uint32(7)) * np.uint32(2654435761) >> np.uint32(20)
        out += np.bincount(three, minlength=DIMS)
        # The first pair behind a border was the last one before it.
        out += np.bincount((two[1 if k else 0 :] * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(out)
    return out / max(np.sqrt((out * out).sum()), 1e-12)


def codewords(n: int) -> np.ndarray:
    """+1/-1 codewords, a row a class: all ways to split up to seven classes, else seeded random ones far apart."""
    if n <= 7:
        columns = [[1 if (c >> i) & 1 or i == 0 else -1 for i in range(n)] for c in range(0, 1 << n, 2)]
        kept = [c for c in columns if -1 in c]
        return np.array(kept, float).T if kept else np.ones((n, 1))
    length, best = int(np.ceil(10 * np.log2(n))), None
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, length))
        apart = min(((code[i] != code[i + 1 :]).sum(axis=1).min() for i in range(n - 1)), default=length)
        if (best is None or apart > best[0]) and (abs(code.sum(axis=0)) < n).all():
            best = (apart, code)
    return best[1]


NUMBERS = ("weights", "bias", "trust")  # of a model, in single precision


class LanguageModel:
    """Weights of one logistic classifier for each bit; ``predict`` decodes by the sum of their losses."""

    def __init__(self, x: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 20.0, decay: float = 1e-4):
        self.languages = sorted(set(label.tolist()))
        self.code = codewords(len(self.languages))
        y = self.code[np.searchsorted(self.languages, label)].astype(np.float32)
        share = np.bincount(np.searchsorted(self.languages, label))
        weight = (1 / share)[np.searchsorted(self.languages, label)]
        weight = (weight / weight.sum()).astype(np.float32)
        self.weights, self.bias = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        speed, speed_b = 0.0, 0.0
        for _ in range(rounds):
            pull = -y / (1 + np.exp(np.clip(y * (x @ self.weights + self.bias), -30, 30))) * weight[:, None]
            speed = 0.9 * speed + x.T @ pull + decay * self.weights
            speed_b = 0.9 * speed_b + pull.sum(axis=0)
            self.weights -= rate * speed / 10
            self.bias -= rate * speed_b / 10
        # A bit weighs as much as its classifier is right on the fitting rows.
        right = ((np.sign(x @ self.weights + self.bias) == y) * weight[:, None]).sum(axis=0)
        self.trust = np.clip(right - 0.5, 1e-3, None) / np.clip(right - 0.5, 1e-3, None).sum()
        # The loss beyond which no codeword is near: from that of fitting rows, a part of the way to that of undecided bits.
        usual = float(np.quantile(self.losses(x).min(axis=1), 0.99))
        self.limit = usual + 0.4 * max(0.0, float(np.log(2)) - usual)

    @classmethod
    def of(cls, languages: list[str], numbers: list[bytes], limit: float) -> LanguageModel:
        """The model with these languages and ``NUMBERS``, fitted elsewhere."""
        self = cls.__new__(cls)
        self.languages, self.limit, self.code = list(languages), limit, codewords(len(languages))
        for name, raw in zip(NUMBERS, numbers):
            setattr(self, name, np.frombuffer(raw, np.float32))
        self.weights = self.weights.reshape(DIMS, -1)
        return self

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The trusted loss of each row for each codeword: 0 if every bit is sure, log 2 if none is decided."""
        margin = x @ self.weights + self.bias
        return np.stack([(self.trust * np.log1p(np.exp(np.clip(-margin * c, -30, 30)))).sum(axis=1) for c in self.code], axis=1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores (share of exp(-loss), 0 to 1), whether the two nearest codewords are too close to call, and
        whether even the nearest is beyond ``limit``."""
        loss = self.losses(x)
        fit = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(self.trust))
        score = fit / fit.sum(axis=1, keepdims=True)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        top = score[np.arange(len(x)), best]
        second = score[np.arange(len(x)), order[:, 1]] if score.shape[1] > 1 else np.zeros(len(x))
        return [self.languages[i] for i in best], top, top - second < 0.1, loss.min(axis=1) > self.limit


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 6000) -> LanguageModel | None:
    """A model of the labelled ``docs``; None if no text has a letter.

    Fitted on at most ``fit_rows`` rows, the same number for each language where there are as many: those whose id and
    text hash lowest, each whole; rows that repeat both count once. Features are counted on all executors; one task gets
    the ``fit_rows`` packed vectors, in a fixed order, and fits; the driver gets the weights alone.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    rows = rows.where(F.col("text").isNotNull())
    different = rows.select("lang", "hash").distinct()
    counts = different.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit_rows)
    n_names = counts.count()
    if not n_names:
        return None
    each = max(1, fit_rows // n_names)
    # Different hashes are even, so this bound passes about 1.5 * each of a language, however many it has.
    bound = F.least(F.lit(1.0), F.lit(1.5 * each + 100) / F.col("count")) * F.lit(2.0**64) - F.lit(2.0**63)
    near = different.join(F.broadcast(counts.select("lang", bound.alias("bound"))), "lang").where(F.col("hash") <= F.col("bound"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    lowest = near.select("lang", "hash", nth.alias("nth")).where(F.col("nth") <= each).groupBy("lang").agg(F.max("hash").alias("last"))
    picked = rows.join(F.broadcast(lowest), "lang").where(F.col("hash") <= F.col("last")).dropDuplicates(["lang", "hash"]).select("lang", "hash", "text")
    sample = picked.mapInArrow(_feature_rows, "lang string, hash long, x binary").repartition(1).sortWithinPartitions("lang", "hash")
    got = sample.select("lang", "x").mapInArrow(_fitted, "languages array<string>, numbers array<binary>, bound double").collect()
    return LanguageModel.of(got[0].languages, got[0].numbers, got[0].bound) if got else None


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the whole sample, in the one task that gets it."""
    labels, parts = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        parts.append(np.array([np.frombuffer(zlib.decompress(x), np.float16) for x in batch.column(1).to_pylist()], np.float32).reshape(-1, DIMS))
    if labels:
        x, n = np.empty((len(labels), DIMS), np.float32), 0
        while parts:  # each part goes as soon as it is copied
            some = parts.pop(0)
            x[n : n + len(some)] = some
            n += len(some)
            del some
        model = LanguageModel(x, np.array(labels))
        numbers = [getattr(model, name).astype(np.float32).tobytes() for name in NUMBERS]
        yield pa.RecordBatch.from_arrays([pa.array([model.languages]), pa.array([numbers], pa.list_(pa.binary())), pa.array([model.limit])], names=["languages", "numbers", "bound"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = [(lang, h, zlib.compress(features(t).astype(np.float16).tobytes(), 1)) for lang, h, t in zip(*(c.to_pylist() for c in batch.columns)) if _letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "hash", "x"])


def _predicted(model: LanguageModel | None, reject: bool = False):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            some = [i for i, t in enumerate(texts) if t and model and _letter(t)]
            for k in range(0, len(some), 256):
                at = some[k : k + 256]
                found, s, u, far = model.predict(np.stack([features(texts[i]) for i in at]))
                score[at], unsure[at] = s, u
                for i, name, out in zip(at, found, far | u):
                    if not (reject and out):
                        lang[i] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(unsure)], names=["who", "lang_pred", "score", "ambiguous"])

    return rows


def predict_languages(docs: DataFrame, model: LanguageModel | None, keep: list[str], text_col: str = "text", reject: bool = False, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``keep`` with lang_pred (a learned language, or ``und``), score (0 to 1) and ambiguous for every row; ``names`` renames these.

    Only the whole text is an input. Null, empty and letterless texts are ``und`` with score 0, as are all texts if
    nothing could be learned. With ``reject``, so are texts that no codeword is near (``LanguageModel.limit``) and
    texts whose two nearest codewords tie; these keep their score and ambiguous. Nothing is shuffled; repeated rows are
    kept; empty tables give no rows.
    """
    kinds = dict(docs.dtypes)
    who = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in keep) + ">"
    found = docs.select(F.struct(*keep).alias("who"), F.col(text_col).alias("text")).mapInArrow(_predicted(model, reject), f"who {who}, lang_pred string, score double, ambiguous boolean")
    return found.select(*(F.col(f"who.`{c}`").alias(c) for c in keep), *(F.col(c).alias(n) for c, n in zip(("lang_pred", "score", "ambiguous"), names)))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for rows whose crc32 of the id as text falls in the fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
