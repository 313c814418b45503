"""Counts of value combinations for many column sets at once, by grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column sets of one GROUPING SETS clause.
CHUNK = 32
SEPARATOR = "\x1f"


def set_id(columns: Column) -> Column:
    """The name of a set of columns, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(columns)), SEPARATOR)


def counts_by_set(cube: DataFrame, by: Sequence[str], columns: Sequence[str], asked: DataFrame, weight: str = "_n") -> DataFrame:
    """(by…, _set, _v, o): for every ``_set`` in ``asked`` the combinations of values that occur, as a map, and their summed weight.

    Each set is grouped once, however many tests or families read it; the sets are as many as the columns allow, not the rows.
    """
    by, columns = list(by), sorted(columns)
    names = sorted(r["_set"] for r in asked.select("_set").distinct().collect())  # column sets
    parts = []
    for begin in range(0, len(names), CHUNK):
        sets = [[c for c in name.split(SEPARATOR) if c] for name in names[begin : begin + CHUNK]]
        grouped = cube.groupingSets([[*by, *s] for s in sets], *by, *columns).agg(F.sum(weight).alias("o"), F.grouping_id(*by, *columns).alias("_gid"))
        # a bit of the grouping id is set where a column is summed over
        ids = F.create_map(*[F.lit(v) for s in sets for v in (sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s), SEPARATOR.join(sorted(s)))])
        values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))
        parts.append(grouped.select(*by, F.element_at(ids, F.col("_gid").cast("int")).alias("_set"), values.alias("_v"), "o"))
    if not parts:
        values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))
        return cube.select(*by, F.lit("").alias("_set"), values.alias("_v"), F.col(weight).alias("o")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
