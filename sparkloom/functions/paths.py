"""File path expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TEST_PATH = r"(?i)(^|/)(tests?|specs?)(/|\.)|\.(test|spec)\."
# Languages of file extensions, case-sensitive.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go",
    ".rs": "rust", ".java": "java", ".rb": "ruby", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".sh": "bash",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".sql": "sql", ".md": "markdown",
}


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


def suffix(path: Column) -> Column:
    """The lower-cased last extension of the last name; none for dotfiles and names ending in a dot."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(table[F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[^.]*)$", 1)], F.lit(""))
