"""Registered queries and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | dict[str, int] = 6) -> Callable[[Query], Query]:
    """Register a query; its doubles are rounded, as sums depend on row order. ``digits`` may differ by column (6 where not named)."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    places = lambda c: digits.get(c, 6) if isinstance(digits, dict) else digits
    doubles = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[
        (F.round(F.col(f"`{c}`"), places(c)) + F.lit(0.0)).alias(c) if c in doubles else F.col(f"`{c}`")
        for c in df.columns])


def r(expression: str, digits: int = 6) -> str:
    """The rounding of :func:`rounded`, in SQL."""
    return f"(round({expression}, {digits}) + 0.0)"
