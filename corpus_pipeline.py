"""A corpus in five stages: each works on all that the one before kept, written as Parquet and read again.

Common to all stages: rows are told apart by doc_id if those are unique integers, else by a hash of doc_id and text (and
source and lang when mixing), so rows that repeat all of these share every verdict. Extra columns, whatever their names, are
kept. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.decontaminate import find_contamination
from sparkloom.llm.language import fit_languages, predict_languages
from sparkloom.llm.mixing import mix_documents
from sparkloom.llm.near_copies import near_copies
from sparkloom.llm.secret_scan import corpus_forest, redact_secrets
from sparkloom.llm.shared import keyed_rows, table, unique_ids, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(docs: DataFrame, *cols: str) -> tuple[DataFrame, str]:
    """``docs`` with a key column of a name of its own, as the operators key rows by doc_id and ``cols``; and that name."""
    key = free_name(docs, "row_key")
    return keyed_rows(docs, "doc_id", *cols, key=key, extra=tuple(c for c in docs.columns if c not in ("doc_id", *cols))), key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a learned language: null, empty and letterless texts, and those the decoder rejects because
    no codeword is near or two tie. Of the others, those without a lang get the predicted one; the rest keeps its columns.

    If no row has both a lang and a text with letters, nothing can be learned and all rows go. Repeated rows share their verdict."""
    model = fit_languages(docs)
    found = free_name(docs, "lang_pred")
    judged = predict_languages(docs, model, docs.columns, reject=True, names=(found, free_name(docs, "score"), free_name(docs, "ambiguous")))
    return judged.where(F.col(found) != "und").withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (5-word shingles, similarity 0.8): that with the smallest doc_id.

    Null, empty and blank texts are one group. A null doc_id comes after all others; of rows that repeat doc_id and text, one stays."""
    kept = near_copies(docs, words=5, similarity=0.8).where("kept").select("row_key").distinct()
    rows, key = keyed(docs, "text")
    rows = rows.join(kept.withColumnRenamed("row_key", key), key, "left_semi")
    if not unique_ids(docs, "doc_id"):
        rows = rows.dropDuplicates([key])
    return rows.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item; null and empty texts overlap none, repeated rows go or stay together."""
    rows, key = keyed(docs, "text")
    hit = find_contamination(rows, table(spark, sf_dir, "benchmark"), id_col=key, item_col="item_id").select(key).distinct()
    return rows.join(hit, key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; every document stays, repeated ones too, and n_chars follows the text where it was given."""
    redacted = redact_secrets(docs, corpus_forest(docs))
    return redacted.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at least once, with topic, weight (expected copies) and copies (times to train on it).

    Null sources and languages are categories of their own; repeated rows are drawn together, each once; columns that have the
    names of the three added ones give way to them."""
    added = ("topic", "weight", "copies")
    drawn = mix_documents(docs).where("copies > 0").select("row_key", *added).dropDuplicates(["row_key"])
    rows, key = keyed(docs, "text", "source", "lang")
    columns = [c for c in docs.columns if c not in added]
    return rows.select(*columns, key).join(drawn.withColumnRenamed("row_key", key), key).select(*columns, *added)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs
