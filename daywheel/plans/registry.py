"""Queries with their SQL twins: one specification of names and types holds for both sides.

A specification lists "name:kind"; kinds are s (text), i (whole number), b (boolean), t (date), d<k> (double, rounded to
k digits) and a<k> (array of doubles, rounded).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(x: Column, digits: int) -> Column:
    """F.round of a double, to the bit: it goes through decimal text only where a tie is near or the number is large.

    Elsewhere the nearest whole number of units is sure, and its quotient is the double nearest to the decimal.
    """
    scale = 10.0**digits
    units = x * scale
    sure = (F.abs(units) < 1e11) & (F.abs(units - F.rint(units)) < 0.4999)
    return F.when(sure, F.rint(units) / scale).otherwise(F.round(x, digits))


def _column(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind[0] == "d":
        return (rounded(c.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)
    if kind[0] == "a":
        return F.transform(c, lambda x: rounded(x.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)
    return c.cast({"s": "string", "i": "bigint", "b": "boolean", "t": "date"}[kind]).alias(name)


def _sql(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind[0] == "d":
        return f"round({q}::DOUBLE, {kind[1:]}) + 0.0::DOUBLE AS {q}"
    if kind[0] == "a":
        return f"list_transform({q}, lambda x: round(x::DOUBLE, {kind[1:]}) + 0.0::DOUBLE) AS {q}"
    return f"{q}::{ {'s': 'VARCHAR', 'i': 'BIGINT', 'b': 'BOOLEAN', 't': 'DATE'}[kind] } AS {q}"


def query(name: str, columns: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query; its result has just the columns named, as told."""
    spec = [part.split(":") for part in columns.split()]

    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).select(*[_column(n, k) for n, k in spec])
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {ctes}\n_q AS ({sql})\nSELECT {', '.join(_sql(n, k) for n, k in spec)} FROM _q"
        return run

    return register
