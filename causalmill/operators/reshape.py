"""Row filters, column selection and category mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


def condition(df: DataFrame, column: str, operator: str, value) -> Column:
    """One comparison; ``!=`` and ``not in`` keep rows whose value is missing."""
    _require(df, [column])
    c = F.col(column)
    if operator == "==":
        return c == F.lit(value)
    if operator == "!=":
        return F.coalesce(c != F.lit(value), F.lit(True))
    if operator in (">", ">=", "<", "<="):
        return {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[operator]
    if operator == "in":
        return c.isin(list(value))
    if operator == "not in":
        return F.coalesce(~c.isin(list(value)), F.lit(True))
    raise ValueError(f"unknown operator: {operator}")


def filter_conditions(df: DataFrame, conditions: Sequence[Mapping]) -> DataFrame:
    """Rows that meet every ``{column, operator, value}``."""
    parts = [condition(df, c["column"], c["operator"], c["value"]) for c in conditions]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _require(df, columns)
    return df.select(*columns)


def collapse_categories(df: DataFrame, column: str, mapping: Mapping[str, str], output: str | None = None) -> DataFrame:
    """Replace mapped values, keep the others."""
    _require(df, [column])
    if not mapping:
        return df.withColumn(output or column, F.col(column))
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(output or column, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def _distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Exact (distinct, non-null) count per column: counts by value first, so hot values collapse before the shuffle."""
    from ..functions.quantiles import value_counts_long

    counts = value_counts_long(df, cols, as_type="string")
    rows = counts.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()
    found = {r["column"]: (r.d, r.n) for r in rows}
    return {c: found.get(c, (0, 0)) for c in cols}


def detect_categorical(df: DataFrame, max_unique: int = 10, max_share: float = 0.05) -> DataFrame:
    """(column, reason, distinct): text columns, and numeric ones with few distinct values."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    from ..functions.quantiles import value_counts_long

    counts = value_counts_long(df, texts + numeric, as_type="string").groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    rows = df.count()
    is_text = F.col("column").isin(texts)
    few = (F.col("distinct") <= max_unique) & (F.col("distinct") < rows * max_share)
    return counts.where(is_text | few).select("column", F.when(is_text, "text").otherwise("few_values").alias("reason"), "distinct")


def group_columns_by_kind(df: DataFrame) -> DataFrame:
    """(column, kind): numeric, boolean (only 0 and 1), datetime or categorical."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    exprs = [F.lit(0).alias("_none")] + [F.bool_and(F.col(c).isin(0, 1)).alias(f"_b{i}") for i, c in enumerate(numeric)]
    flags = df.agg(F.max(F.lit(1)).alias("_any"), *exprs[1:])
    rows = []
    for f in df.schema:
        if f.name in numeric:
            kind = F.when(F.coalesce(F.col(f"_b{numeric.index(f.name)}"), F.lit(False)), "boolean").otherwise("numeric")
        elif isinstance(f.dataType, T.BooleanType):
            kind = F.lit("boolean")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kind = F.lit("datetime")
        else:
            kind = F.lit("categorical")
        rows.append(F.struct(F.lit(f.name).alias("column"), kind.alias("kind")))
    return flags.select(F.inline(F.array(*rows)))
