"""Query registry: ``QUERIES[name] -> (spark, sf_dir) -> DataFrame`` and the
matching DuckDB oracle SQL in ``ORACLE[name]`` (over the raw driver tables).

Output columns are aliased identically on both sides; doubles that come from
division are rounded to 6 digits on both sides, sums are cast to BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.fixture import ORACLE_PREFIX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, cte: bool = False):
    """Register a builder.  ``sql`` is the oracle body; with ``cte=True`` it
    continues the fixture's WITH clause (starts with ``, name AS (...)``)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = (ORACLE_PREFIX.rstrip() if cte else ORACLE_PREFIX) + sql
        return fn
    return deco


def r6(c: str, alias: str | None = None):
    return F.round(F.col(c), 6).alias(alias or c)
