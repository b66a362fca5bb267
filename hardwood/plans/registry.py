"""Queries by name, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL for its rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


#: Decimals to which sums are compared that engines add up in other orders.
DIGITS = 9


def rounded(df: DataFrame) -> DataFrame:
    """``df`` with its doubles rounded to ``DIGITS``, by binary steps as the SQL rounds: Spark's own ``round`` goes by the decimals that a double prints, which is another side of some ties."""
    scale = 10.0**DIGITS
    near = lambda c: F.when(F.abs(c) < 1e290, F.round(F.col(c) * scale) / scale).otherwise(F.col(c))
    return df.select(*[near(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def round_sql(body: str, columns: str | list[str]) -> str:
    """A query's SQL with those columns rounded alike."""
    names = columns.split() if isinstance(columns, str) else columns
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}' for c in names)}) FROM ({body})"
