"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from auditlake.plans import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def oracle() -> dict[str, str]:
    """Complete statements; composed once every module has named its subqueries."""
    return {name: duck.compose(sql) for name, sql in _SQL.items()}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as 64-bit, so that both engines report the same types."""
    narrow = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, narrow) else F.col(f"`{f.name}`") for f in df.schema]
    )


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` may name any subquery of ``duck.CTES``."""

    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register
