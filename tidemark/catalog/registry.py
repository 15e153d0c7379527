"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog.views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the definitions of the views a statement uses in front of it."""
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in used)
    body = sql.strip()
    start = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if start:
        word = "WITH RECURSIVE " if start.group(1) else "WITH "
        rest = body[start.end():]
        return f"{word}{ctes + ',' if ctes else ''} {rest}"
    return f"WITH {ctes} {body}" if ctes else body


def in_utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Times without a zone are read as UTC, so the session zone must be UTC too."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its check if SQL can express it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = in_utc(fn)
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
