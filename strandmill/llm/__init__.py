"""Operators of a training-data pipeline, one module each; nothing else in the library imports them.

``queries()`` and ``oracle_sql()`` give the registered queries and their DuckDB SQL.
"""

from strandmill.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
