"""Every registered query of the library, by name, with its DuckDB SQL."""

from __future__ import annotations

FLAGSHIP = "r4_live_top_k"

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``; ``sql`` is its DuckDB counterpart."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


from sparkloom.plans import catalogue, claim_queries, index_queries, sink_queries  # noqa: E402, F401  registers the queries
