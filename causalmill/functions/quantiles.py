"""Exact quantiles, ranks and modes without gathering a column into one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .ordered import with_running_sums


def unpivot(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """(by…, column, value) long form of ``cols``."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in cols]
    return df.select(*by, F.inline(F.array(*pairs)))


def value_counts_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """Counts of every non-null value of every column; repeated values collapse on the map side."""
    long = unpivot(df, cols, by, as_type).where(F.col("value").isNotNull())
    return long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, n, q0…q{k}) with linear interpolation between order statistics.

    ``percentile`` keeps all distinct values of a group in one reducer; here they stay range-partitioned and only the two
    order statistics around each quantile are picked. Whole-table quantiles first narrow every quantile to a short value
    interval (see ``_whole_table``), so that little is shuffled.
    """
    if not by:
        narrow = _whole_table(df, cols, qs)
        if narrow is not None:
            return narrow
    counts = value_counts_long(df, cols, by)
    ranked = with_running_sums(counts, ["value"], {"cum": F.col("n")}, [*by, "column"])
    picks = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("cum_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("cum") > rank) & (F.col("cum") - F.col("n") <= rank)
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"_{side}{i}"))
    wide = ranked.groupBy(*by, "column").agg(F.max("cum_total").alias("n"), *picks)
    out = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(f"q{i}"))
    return wide.select(*by, "column", "n", *out)


_SKETCH = 5000  # rank error of the quantile sketch is n / _SKETCH
_NARROW = 1_000_000  # distinct values of a column's intervals that one window task may sort


def _whole_table(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame | None:
    """Quantiles of whole columns by two scans: a sketch gives an interval around each order statistic, then the rows
    below and inside it are counted exactly. None when an interval misses its rank or holds too many distinct values."""
    rows = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    marks = sorted({min(max(q + d * 3.0 / _SKETCH, 0.0), 1.0) for q in qs for d in (-1, 1)})
    aggs = []
    for i in range(len(cols)):
        aggs += [F.count(f"_x{i}").alias(f"n{i}"), F.percentile_approx(f"_x{i}", marks, _SKETCH).alias(f"m{i}")]
    head = rows.agg(*aggs).first()
    recs = []
    for i in range(len(cols)):
        if not head[f"n{i}"]:
            continue
        at = dict(zip(marks, head[f"m{i}"]))
        spans: list[list[float]] = []  # disjoint intervals in value order
        for lo, hi in sorted(tuple(at[min(max(q + d * 3.0 / _SKETCH, 0.0), 1.0)] for d in (-1, 1)) for q in qs):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        x = F.col(f"_x{i}")
        past = F.lit(0)
        for _, hi in spans:
            past = past + (x > F.lit(hi)).cast("int")
        low = F.get(F.array(*[F.lit(lo) for lo, _ in spans]), past)  # null beyond the last interval
        # rows between two intervals only count; rows inside one keep their value
        recs.append(F.struct(F.lit(i).alias("i"), past.alias("g"), F.when(x >= low, x).alias("v"), x.isNotNull().alias("known")))
    spark = df.sparkSession
    if not recs:
        return spark.createDataFrame([], "column string, n long, " + ", ".join(f"q{k} double" for k in range(len(qs))))
    counts = rows.select(F.inline(F.array(*recs))).where("known").groupBy("i", "g", "v").agg(F.count(F.lit(1)).alias("c"))
    counts = cut_lineage(counts)
    if (counts.groupBy("i").count().agg(F.max("count")).first()[0] or 0) > _NARROW:
        return None
    run = counts.withColumn("cum", F.sum("c").over(Window.partitionBy("i").orderBy("g", F.col("v").asc_nulls_first())))
    sizes = F.array(*[F.lit(head[f"n{i}"]) for i in range(len(cols))])
    picks = []
    for k, q in enumerate(qs):
        at_rank = F.lit(float(q)) * (F.get(sizes, F.col("i")) - 1)
        for side, r in (("lo", F.floor(at_rank)), ("hi", F.ceil(at_rank))):
            picks.append(F.max(F.when((F.col("cum") > r) & (F.col("cum") - F.col("c") <= r), F.col("v"))).alias(f"{side}{k}"))
    got = {r["i"]: r for r in run.groupBy("i").agg(*picks).collect()}  # one row per column
    out = []
    for i, c in enumerate(cols):
        n = head[f"n{i}"]
        if not n:
            continue
        vals = []
        for k, q in enumerate(qs):
            lo, hi = got[i][f"lo{k}"], got[i][f"hi{k}"]
            if lo is None or hi is None:
                return None
            pos = float(q) * (n - 1)
            vals.append(lo + (pos - math.floor(pos)) * (hi - lo))
        out.append((c, n, *vals))
    return spark.createDataFrame(out, "column string, n long, " + ", ".join(f"q{k} double" for k in range(len(qs))))


def collect_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of whole columns on the driver: ``len(cols) * len(qs)`` numbers."""
    rows = {r["column"]: r for r in exact_quantiles(df, cols, qs).collect()}
    return {c: [rows[c][f"q{i}"] if c in rows else None for i in range(len(qs))] for c in cols}


def average_ranks(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, value, n, rank) with tied values sharing their average rank (1-based)."""
    counts = value_counts_long(df, cols, by)
    ranked = with_running_sums(counts, ["value"], {"cum": F.col("n")}, [*by, "column"])
    return ranked.select(
        *by, "column", "value", "n", (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"), F.col("cum_total").alias("total")
    )


def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """(by…, column, value, n): most frequent value, the smallest on ties."""
    counts = value_counts_long(df, cols, by, as_type)
    best = F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
    return counts.groupBy(*by, "column").agg(best.alias("b")).select(*by, "column", "b.value", "b.n")
