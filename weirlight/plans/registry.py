"""Every query of the lineage engine, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


from weirlight.plans import extraction, lineage_queries, shapes, source_queries  # noqa: E402

assert lineage_queries and shapes and source_queries
for _name, _case in extraction.CASES.items():
    QUERIES[f"extract_{_name}"], ORACLE[f"extract_{_name}"] = _case.query, _case.sql()
