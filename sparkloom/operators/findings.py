"""Findings of the text-generation step: evidence, validation, contradictions, near-duplicates and clusters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import text

MAX_COMMENTS, MAX_EVIDENCE, MAX_CONTEXT, MAX_CALLS = 5, 10_000, 12_000, 12
JACCARD, RATIO = 0.82, 0.88
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def within_budget(rows: DataFrame, key: str, order: list[Column], line: str, max_rows: int = MAX_COMMENTS, max_chars: int = MAX_EVIDENCE) -> DataFrame:
    """The first lines of each key that fit ``max_chars``; the last one is cut. Adds ``nth`` (from 0).

    A line costs its length and one more; each but the first needs one more still to start.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("nth", F.row_number().over(w) - 1).where(F.col("nth") < max_rows)
    spent = F.coalesce(F.sum(F.length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(max_chars) - spent - F.when(F.col("nth") > 0, 1).otherwise(0)
    return numbered.withColumn("__left", left).where("__left > 0").withColumn(line, F.expr(f"left(`{line}`, cast(__left as int))")).drop("__left")


def validated(replies: DataFrame, reply: str = "reply", candidates: str = "candidates") -> DataFrame:
    """``replies`` with one row a supported finding: reply_pos, concern, evidence, confidence, suggested_check, is_inference, source_comments.

    ``reply`` is JSON text ({"concerns": [...]}), ``candidates`` the array that source_indices point into. Every item is
    judged by its own JSON types; one that is malformed takes no other with it. Findings whose concern or evidence is no
    text or blank, or whose indices are no list or hold no valid whole number, go. A confidence that is no number (or
    text of one) in 0 to 1 becomes null; only a JSON true is an inference. An unreadable reply has no findings.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    a_text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    listed = lambda v: F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    items = replies.select("*", F.posexplode(listed(part(F.try_parse_json(reply), "concerns"))).alias("reply_pos", "c")).where(kind(F.col("c")).startswith("OBJECT"))
    whole = F.transform(F.filter(listed(part(F.col("c"), "source_indices")), lambda i: kind(i) == "BIGINT"), lambda i: F.try_variant_get(i, "$", "bigint"))
    good = F.filter(whole, lambda i: (i >= 0) & (i < F.size(candidates)))
    given = part(F.col("c"), "confidence")
    number = F.when((kind(given) != "STRING") | a_text(given).rlike(NUMBER), F.try_variant_get(given, "$", "double"))
    inference = part(F.col("c"), "is_inference")
    return (
        items.withColumn("source_comments", F.transform(good, lambda i: F.get(candidates, i.cast("int"))))
        .withColumn("concern", text.strip(a_text(part(F.col("c"), "concern")))).withColumn("evidence", text.strip(a_text(part(F.col("c"), "evidence"))))
        .where("concern <> '' and evidence <> '' and size(source_comments) > 0")
        .withColumn("confidence", F.when(number.between(0, 1) & ~F.isnan(number), number))
        .withColumn("suggested_check", a_text(part(F.col("c"), "suggested_check"))).withColumn("is_inference", F.coalesce((kind(inference) == "BOOLEAN") & F.try_variant_get(inference, "$", "boolean"), F.lit(False)))
        .drop("c", reply)
    )


def contradicted(concern: Column, file_context: Column, all_contexts: Column) -> Column:
    """True if the change itself disproves a claim of a missing symbol or type.

    Some identifier of the concern is imported in ``file_context`` and declared in ``all_contexts``; null context of
    the files that triggered the finding disproves nothing.
    """
    claim = F.coalesce(concern, F.lit(""))
    blocks = F.array_join(F.regexp_extract_all(F.coalesce(file_context, F.lit("")), F.lit(text.IMPORT_BLOCK), F.lit(0)), "\n")
    lines = F.array_join(F.filter(F.split(F.coalesce(all_contexts, F.lit("")), "\r\n|[\n\r]"), lambda x: x.rlike(text.DECLARATION)), "\n")
    shared = F.array_intersect(F.array_intersect(text.identifiers(claim), text.identifiers(blocks)), text.identifiers(lines))
    return (claim.rlike(text.MISSING_SYMBOL_CLAIM) | claim.rlike(text.TYPE_CLAIM)) & F.coalesce(F.size(shared) > 0, F.lit(False))


def same_finding(a: Column, b: Column, a_inference: Column, b_inference: Column, ratio: Column | None = None) -> Column:
    """Whether two concerns say the same; ``ratio`` is the sequence ratio of their lower-cased texts where known."""
    left, right = text.strip(F.coalesce(a, F.lit(""))), text.strip(F.coalesce(b, F.lit("")))
    family = F.arrays_overlap(text.identifiers(left), text.identifiers(right)) & F.arrays_overlap(text.issue_families(left), text.issue_families(right))
    near = F.coalesce(text.jaccard(text.tokens(left), text.tokens(right)) >= JACCARD, F.lit(False))
    both = (F.size(text.tokens(left)) > 0) & (F.size(text.tokens(right)) > 0)
    close = F.lit(False) if ratio is None else both & (ratio >= RATIO)
    return F.coalesce(a_inference == b_inference, F.lit(False)) & (left != "") & (right != "") & ((F.lower(left) == F.lower(right)) | family | near | close)


class _Concern:
    """What the pair rule looks at, computed once a finding."""

    identifier, token = re.compile(text.IDENTIFIER, re.A), re.compile("[a-z0-9_]+")
    families = {"missing": re.compile(text.MISSING_SYMBOL_FAMILY), "type": re.compile(text.TYPE_FAMILY)}
    stop = frozenset(text.STOP_WORDS)

    def __init__(self, concern, inference):
        raw = (concern or "").strip()
        self.low, self.inference = raw.lower(), bool(inference)
        self.ids = set(self.identifier.findall(raw))
        self.kinds = {k for k, p in self.families.items() if p.search(self.low)}
        self.words = set(self.token.findall(self.low)) - self.stop

    def same(self, other: _Concern) -> bool:
        if self.inference != other.inference or not self.low or not other.low:
            return False
        if self.low == other.low or self.ids & other.ids and self.kinds & other.kinds:
            return True
        if not self.words or not other.words:
            return False
        union = self.words | other.words
        if len(self.words & other.words) / len(union) >= JACCARD:
            return True
        # The two quick ratios are upper bounds of the ratio, so the slow one is taken only where it can decide.
        m = SequenceMatcher(None, self.low, other.low)
        return m.real_quick_ratio() >= RATIO and m.quick_ratio() >= RATIO and m.ratio() >= RATIO


class _Merge:
    """A table function over one review's findings in order: it holds the kept ones only."""

    def __init__(self):
        self.kept: list[tuple[int, _Concern]] = []

    def eval(self, row):
        key, pos, concern, inference = row
        this = _Concern(concern, inference)
        home = next((p for p, old in self.kept if old.same(this)), None)
        if home is None:
            self.kept.append((pos, this))
        yield key, pos, pos if home is None else home


class _Cluster:
    """A table function over one review's groups in order: it holds what each cluster has gathered."""

    def __init__(self):
        self.open: list[tuple[int, set, set]] = []

    def eval(self, row):
        key, pos, symbols, evidence = row
        s, e = set(symbols or ()), set(evidence or ())
        home = next((c for c in self.open if s & c[1] and e & c[2]), None)
        if home is None:
            self.open.append((pos, s, e))
        else:
            home[1].update(s)
            home[2].update(e)
        yield key, pos, pos if home is None else home[0]


def _folded(rows: DataFrame, function: type, key: str, result: str) -> DataFrame:
    """``function`` over each key's rows in order of pos: PARTITION BY and ORDER BY of a table function, so rows pass one by one."""
    kinds = dict(rows.dtypes)
    return F.udtf(function, returnType=f"{key} {kinds[key]}, pos {kinds['pos']}, {result} {kinds['pos']}")(rows.asTable().partitionBy(key).orderBy("pos"))


def merged(findings: DataFrame, key: str = "review_id") -> DataFrame:
    """``findings`` (key, pos, concern, is_inference, ...) with ``kept_pos``: the earlier finding that absorbs each.

    An ordered fold a review: a finding joins the first kept one whose own concern it repeats, else it is kept. A task holds
    the kept findings of one review, never a whole group; time grows with the product of a review's findings and its kept ones.
    """
    return _folded(findings.select(key, "pos", "concern", "is_inference"), _Merge, key, "kept_pos")


def union_of_evidence(findings: DataFrame, homes: DataFrame, key: str = "review_id", source: str = "source_key") -> DataFrame:
    """(key, pos, n_merged, confidence, sources): the highest confidence (null counts 0 once merged) and all sources."""
    rows = findings.join(homes, [key, "pos"])
    return rows.groupBy(key, F.col("kept_pos").alias("pos")).agg(
        F.count("*").alias("n_merged"),
        F.when(F.count("*") > 1, F.max(F.coalesce("confidence", F.lit(0.0)))).otherwise(F.max("confidence")).alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(source)))).alias("sources"),
    )


def clusters(groups: DataFrame, key: str = "review_id") -> DataFrame:
    """(key, pos, cluster_pos) for ``groups`` (key, pos, symbols, evidence): an ordered fold.

    A group joins the first cluster that shares a symbol and a piece of evidence with what it has gathered so far; two
    clusters never merge. A task holds the clusters of one review.
    """
    return _folded(groups.select(key, "pos", "symbols", "evidence"), _Cluster, key, "cluster_pos")


def synthesized(requests: DataFrame, provider: Callable[[list[dict]], list[str | None]], schema: str, inputs: list[str]) -> DataFrame:
    """``requests`` with ``reply`` and ``failed``: the provider answers batches; None or an error is a failure, not "no findings"."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies = provider(batch[inputs].to_dict("records"))
            except Exception as error:  # a provider's failure is data
                replies = [None] * len(batch)
                batch = batch.assign(error=str(error)[:2000])
            else:
                batch = batch.assign(error=None)
            yield batch.assign(reply=replies, failed=[r is None for r in replies])

    return requests.mapInPandas(rows, f"{schema}, error string, reply string, failed boolean")
