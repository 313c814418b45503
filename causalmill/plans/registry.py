"""Registration of queries over the given tables, with the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that the order of summation does not show; ``+ 0.0`` turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def rounded_sql(sql: str, keep: str, values: str, digits: int = 6) -> str:
    """The same rounding on the SQL side: ``keep`` and ``values`` are space-separated column names of ``sql``."""
    cols = keep.split() + [f"round({v}, {digits}) + 0.0 AS {v}" for v in values.split()]
    body = sql.strip()
    return f"SELECT {', '.join(cols)} FROM ({body}) AS _result"
