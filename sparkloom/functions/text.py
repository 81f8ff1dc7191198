"""Text predicates, extraction and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the analysis.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "in", "is", "it", "may", "might", "of", "on", "or", "that", "the",
    "this", "to", "with", "without", "which", "could", "should", "would",
    "issue", "check", "verify", "ensure", "file", "code", "concern",
]
# ASCII boundaries, written out: what \b takes for a word beside letters like É depends on the version of Java.
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]{3,}(?![A-Za-z0-9_])"
MISSING_SYMBOL_CLAIM = r"(?i)\b(undefined|not defined|unimported|not imported|missing import|implicit.any)\b"
TYPE_CLAIM = r"(?i)\b(implicit.any|type information|type annotation|explicit type)\b"
MISSING_SYMBOL_FAMILY = r"undefined|not defined|unimported|not imported|missing import"
TYPE_FAMILY = r"implicit.any|implicit-any|type information|type annotation|explicit type|typing"
IMPORT_BLOCK = r"(?s)\bimport\b(?:(?!;).){0,1000}?\bfrom\b"
DECLARATION = r"\b(export|declare|const|let|var|type|interface|class|enum)\b"


def strip(c: Column) -> Column:
    """Without white space at both ends (all kinds, unlike ``trim``)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def identifiers(c: Column) -> Column:
    """Distinct upper-case ASCII identifiers of four characters or more, in order of appearance; any other letter ends one."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(IDENTIFIER), F.lit(0)))


def tokens(c: Column) -> Column:
    """Distinct lower-case words that are not stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def issue_families(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(F.when(low.rlike(MISSING_SYMBOL_FAMILY), "missing_symbol"), F.when(low.rlike(TYPE_FAMILY), "type_information")))


def contains_marker(c: Column, markers: list[str]) -> Column:
    """True if any marker occurs anywhere, case-sensitive; null text has none."""
    found = F.lit(False)
    for m in markers:
        found |= F.coalesce(F.contains(c, F.lit(m)), F.lit(False))
    return found


def body_key(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def source_key(url: Column, owner: Column, repo: Column, path: Column, body: Column) -> Column:
    """The url if there is one, else owner, repository, path and body together."""
    return F.coalesce(F.nullif(url, F.lit("")), F.to_json(F.struct(owner.alias("o"), repo.alias("r"), path.alias("p"), body.alias("b")), {"ignoreNullFields": "false"}))


def review_key(path: Column, hunk: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\0"), hunk), 256)


def table_cell(c: Column, limit: int = 90) -> Column:
    """One line for a Markdown table cell: line ends as spaces, pipes escaped, cut with an ellipsis."""
    flat = strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def percent(c: Column) -> Column:
    """A share as whole per cent, half to even."""
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def truncated_percent(c: Column) -> Column:
    return F.concat((c * 100).cast("int").cast("string"), F.lit("%"))


def plural(n: Column, word: str, suffix: str = "s") -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, suffix).otherwise(""))


def token_estimate(prompt: Column) -> Column:
    return F.floor((F.length(prompt) + 3) / 4).cast("long")


def evidence_line(nth: Column, similarity: Column, body: Column, path: Column) -> Column:
    return F.format_string("[%d] [%.2f similarity] %s (from %s)", nth, F.coalesce(similarity, F.lit(0.0)), F.coalesce(body, F.lit("")), F.coalesce(path, F.lit("")))


def error_category(code: Column, kind: Column) -> Column:
    both = F.lower(F.concat_ws(" ", code, kind))
    return F.when(both.rlike("quota|billing|insufficient_quota"), "quota_exhausted").when(both.rlike("auth|api_key|permission"), "authentication_or_permission").otherwise("rate_limited")


def outcome(external_failure: Column, partial: Column, findings: Column, similar: Column) -> Column:
    return (
        F.when(external_failure, "external_failure").when(partial, "partial_request_limit").when(findings > 0, "completed_with_findings")
        .when(similar > 0, "completed_no_actionable_findings").otherwise("general_analysis_only")
    )


def durable_status(c: Column) -> Column:
    """The status kept for an outcome; unknown outcomes count as completed with findings."""
    return F.when(c == "completed_no_actionable_findings", "completed_no_findings").when(c.isin("general_analysis_only", "partial_request_limit"), c).otherwise("completed_with_findings")
