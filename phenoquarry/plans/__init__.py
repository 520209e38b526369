"""Registered queries: relational and matched (native, with DuckDB texts), grouped (grouped maps and kernels)."""

from . import documents, grouped, kernels, matched, relational

QUERIES = relational.QUERIES | grouped.QUERIES  # documents, kernels and matched register into relational's
ORACLE_SQL = relational.ORACLE_SQL | grouped.ORACLE_SQL
FLAGSHIP = relational.QUERIES["flagship_pair_summary"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "documents", "kernels", "matched"]
