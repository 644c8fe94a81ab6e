"""All registered queries of the library and their SQL."""

from . import figure_queries, import_queries, ingest_queries, whole_queries  # noqa: F401 - they register their queries
from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
