"""A register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: events as narrations, in DuckDB.
N = """n AS (SELECT user_id AS video_uid, epoch_us(ts) / 3600000000.0 AS t, event_id AS uid, event_type || ' ' || props AS txt,
  event_type = 'error' AS unsure, event_type AS template, value AS d FROM events)"""


def bucket_sql(d: str) -> str:
    return f"(CASE WHEN {d} >= 0 AND {d} < 2 THEN 0 WHEN {d} >= 2 AND {d} < 4 THEN 2 WHEN {d} >= 4 AND {d} < 8 THEN 4 WHEN {d} >= 8 AND {d} < 16 THEN 8 WHEN {d} >= 16 AND {d} < 32 THEN 16 ELSE 32 END)::DOUBLE"


def high_sql(lo: str) -> str:
    return f"(CASE {lo} WHEN 0 THEN 2 WHEN 2 THEN 4 WHEN 4 THEN 8 WHEN 8 THEN 16 WHEN 16 THEN 32 ELSE 60 END)::DOUBLE"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
