"""Unified diffs: hunks, summaries, context and previews, over ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import paths, text

HUNK_START = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
ANY_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def starting_line(hunk: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(hunk, F.lit("")), HUNK_START, 1), F.lit("")).try_cast("int")


def _named(lines: Column) -> Column:
    """The path that the last ``+++ b/`` line of ``lines`` names; null without one."""
    return F.substr(F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), lines), lambda x: x.isNull() | x.startswith("+++ b/")), -1), F.lit(7))


def split_hunks(diffs: DataFrame, key: str, diff: str, attribution: str = "compat", floor: int = 30) -> DataFrame:
    """(key, pos, path, hunk) of each hunk over ``floor`` characters, in order from 0.

    "compat" gives a hunk the path named last before the next hunk starts, so that a file's last hunk goes to the next
    file, as callers of the analysis have always seen; "strict" gives it the path named before it starts. Path lines
    are no part of a hunk; null diffs have none. Each diff is cut within its row: nothing is shuffled.
    """
    parts = F.transform(F.split(diff, r"\n(?=@@)"), lambda p: F.split(p, "\n"))
    cut = diffs.select(key, parts.alias("__parts")).withColumn("__paths", F.transform("__parts", _named))
    last = lambda i: F.coalesce(F.element_at(F.filter(F.concat(F.array(F.lit("")), F.slice("__paths", 1, i)), lambda x: x.isNotNull()), -1), F.lit(""))
    hunks = F.transform(
        "__parts",
        lambda lines, i: F.struct(
            i.alias("nth"), lines[0].startswith("@@").alias("starts"), last(i + (1 if attribution == "compat" else 0)).alias("path"),
            F.array_join(F.filter(lines, lambda x: ~x.startswith("+++ b/")), "\n").alias("hunk"),
        ),
    )
    kept = F.filter(hunks, lambda h: h["starts"] & (F.length(text.strip(h["hunk"])) > floor))
    return cut.select(key, F.posexplode(kept).alias("pos", "h")).select(key, "pos", "h.path", "h.hunk")


def line_counts(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, path, first_at, added, removed, is_test) of each file a diff names; only counts are shuffled."""
    count = lambda lines, sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    sections = F.split(F.concat(F.lit("\n"), F.col(diff)), rf"(?:{ANY_LINE_END})(?=\+\+\+ b/)")
    cut = diffs.select(key, F.posexplode(F.transform(F.slice(sections, 2, 1 << 30), lambda p: F.split(p, ANY_LINE_END))).alias("at", "lines"))
    rows = cut.select(key, F.expr("substring(lines[0], 7)").alias("path"), "at", count(F.col("lines"), "+").alias("a"), count(F.col("lines"), "-").alias("r")).where("path <> ''")
    counts = rows.groupBy(key, "path").agg(F.min("at").alias("first_at"), F.sum("a").alias("added"), F.sum("r").alias("removed"))
    return counts.withColumn("is_test", paths.is_test_path(F.col("path")))


def summarize(counts: DataFrame, key: str) -> DataFrame:
    """(key, files, file_count, added, removed, test_files), files in order of appearance."""
    files = F.array_sort(F.collect_list(F.struct("first_at", "path", "added", "removed", "is_test")))
    whole = counts.groupBy(key).agg(files.alias("f"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    return whole.select(
        key, F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["added"].alias("added"), x["removed"].alias("removed"))).alias("files"), F.size("f").alias("file_count"), "added", "removed",
        F.transform(F.filter("f", lambda x: x["is_test"]), lambda x: x["path"]).alias("test_files"),
    )


def overview(summary: DataFrame) -> Column:
    """The factual change overview of a summary's columns."""
    files, tests, n = F.col("files"), F.col("test_files"), F.col("file_count")
    listed = F.transform(F.slice(files, 1, 12), lambda x: F.format_string("- `%s (+%d/-%d)`", x["path"], x["added"], x["removed"]))
    more = F.when(n > 12, F.array(F.format_string("- `…and %d more changed files`", n - 12))).otherwise(F.array().cast("array<string>"))
    tested = F.concat(F.lit("**Test files changed:** "), F.array_join(F.transform(F.slice(tests, 1, 8), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", "))
    untested = F.lit("**Tests:** none are part of this diff, so run those that cover the code it touches.")
    head = F.format_string("**Changed areas (%d files; +%d/-%d lines):**", n, F.col("added"), F.col("removed"))
    body = F.array_join(F.concat(F.array(head), listed, more, F.array(F.when(F.size(tests) > 0, tested).otherwise(untested))), "\n")
    return F.when(n > 0, body).otherwise("The diff holds no change of a file that could be reviewed.")


def joined_in_order(rows: DataFrame, key: list[str], pos: str, part: str, separator: str = "\n...\n") -> DataFrame:
    """(key, context): the parts of each key in order of ``pos``, joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(part).alias("t")))), lambda x: x["t"])
    return rows.groupBy(*key).agg(F.array_join(parts, separator).alias("context"))


def relevant_lines(hunk: Column, limit: int = 8) -> Column:
    """The added lines worth showing: no blanks, imports, client or logger set-up, nor multi-line strings."""
    lines = F.transform(F.filter(F.split(hunk, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substr(x, F.lit(2)))
    clean = F.filter(lines, lambda x: (text.strip(x) != "") & ~text.strip(x).rlike(r"^(import |from |logger = |client = )") & ~F.contains(x, F.lit("= structlog")))
    quoted = lambda x: F.contains(x, F.lit('"""')) | F.contains(x, F.lit("'''"))
    state = F.aggregate(
        clean, F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept")),
        lambda s, x: F.struct(F.when(quoted(x), ~s["inside"]).otherwise(s["inside"]).alias("inside"), F.when(quoted(x) | s["inside"], s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept")),
    )
    kept = state["kept"]
    more = F.when(F.size(kept) > limit, F.format_string("\n... (%d more lines)", F.size(kept) - limit)).otherwise("")
    return F.concat(F.array_join(F.slice(kept, 1, limit), "\n"), more)


def first_n(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key with ``truncated``: whether the key has more."""
    w = Window.partitionBy(key)
    return rows.withColumn("truncated", F.count("*").over(w) > limit).withColumn("nth", F.row_number().over(w.orderBy(*order))).where(F.col("nth") <= limit)
