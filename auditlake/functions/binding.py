"""Helpers that keep a costly expression from being evaluated more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it.

    Without it a nested expression repeats its input at every mention, and the plan grows exponentially.
    """
    return F.transform(F.array(value), body).getItem(0)


def unpack(df: DataFrame, array: str | Column, item: str, position: str | None = None) -> DataFrame:
    """One row per array element, next to the row's own columns.

    The outer generator plus a filter on its output is deliberate: with the inner one the optimizer derives a
    "not empty" filter on the array and pushes it down to the scan, which computes a costly array twice.
    """
    pos = position or "_pos"
    out = df.select("*", F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())
    return out if position else out.drop("_pos")
