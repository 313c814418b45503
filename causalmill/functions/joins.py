"""Joins with a side that is usually small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage, row_bound

BROADCAST_ROWS = 200_000


def join_checked(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join on equal (or both null) keys; ``table`` is stored, counted, and broadcast only up to ``limit`` rows.

    A longer table goes through a shuffle join, where adaptive execution splits hot keys.
    """
    stored = cut_lineage(table)
    right = stored.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in stored.columns if c not in on])
    cond = None
    for c in on:
        eq = df[c].eqNullSafe(right[f"_k_{c}"])
        cond = eq if cond is None else cond & eq
    if row_bound(stored, limit) <= limit:
        right = F.broadcast(right)
    return df.join(right, cond, how).drop(*[f"_k_{c}" for c in on])


def zip_single_rows(*tables: DataFrame) -> DataFrame:
    """Side by side columns of tables that hold one row each."""
    out = tables[0].withColumn("_one", F.lit(1))
    for t in tables[1:]:
        out = out.join(F.broadcast(t.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")
