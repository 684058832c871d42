"""What all plan modules share: the registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 3


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries of the name {key!r}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def with_(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " "


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or [c for c, t in df.dtypes if t == "double"]:
        df = df.withColumn(c, F.round(c, 6))
    return df
