"""Ordered computations that never put a whole series into one task.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends each series to one task, which fails when one series holds a
large share of a long table. Here the rows are range-partitioned on (series, order key), so every task holds a slice of
about equal size, and the slices are tied together by a table with one row per (slice, series).

``order`` must identify rows uniquely within a series (add a key column to break ties); otherwise tied rows come in an
arbitrary order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

SERIES_LIMIT = 1_000_000  # rows of one series that a single window task may hold
_INDEX_BITS = 33  # monotonically_increasing_id = partition << 33 | row index


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _asc(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _desc(order: Sequence[str | Column]) -> list[Column]:
    """The reverse of ``_asc``. A frame that ends at the last row is evaluated anew for every row; over the reversed order it is a running one."""
    return [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]


def range_slices(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """Sort the table over all tasks; adds ``_slice`` (task) and ``_idx`` (row number inside the slice)."""
    keys = [F.col(c) for c in by] + _asc(order)
    ranged = (
        df.repartitionByRange(_parts(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_mid", _INDEX_BITS).cast("int"))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)))
        .drop("_mid")
    )
    # range bounds come from a sample, so the two uses below must read one stored result
    return cut_lineage(ranged)


def fits_one_task(df: DataFrame, by: Sequence[str] = ()) -> bool:
    """True when no series is longer than ``SERIES_LIMIT``; a plain window per series is then safe and needs one shuffle."""
    sizes = df.groupBy(*by).count().agg(F.max("count"))
    return (sizes.first()[0] or 0) <= SERIES_LIMIT


def _series(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def framed(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str],
    before: int,
    after: int,
    make: Callable[[Window], Mapping[str, Column]],
    block_rows: int = 65536,
) -> DataFrame:
    """Add the columns that ``make(window)`` builds from frames reaching at most ``before`` back and ``after`` ahead.

    Series that all fit one task use a window per series; otherwise the series are positioned and cut into blocks.
    """
    if fits_one_task(df, by):
        return df.select("*", *[e.alias(k) for k, e in make(_series(by).orderBy(*_asc(order))).items()])
    rows, window, own = with_neighbours(with_position(df, order, by), before, after, by, block_rows=block_rows)
    new = make(window)
    return rows.select("*", *[e.alias(k) for k, e in new.items()]).where(own).select(*df.columns, *new)


def _slice_key(by: Sequence[str]) -> list[str]:
    return ["_slice", *by]


def _join_runs(rows: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    on = F.col("r._slice") == F.col("u._slice")
    for c in by:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"u.{c}"))
    extra = [F.col(f"u.{c}") for c in runs.columns if c not in _slice_key(by)]
    # one run per slice when there is one series: bounded by the number of slices
    right = runs if by else F.broadcast(runs)
    return rows.alias("r").join(right.alias("u"), on).select("r.*", *extra)


def with_position(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "_pos", length: str | None = None
) -> DataFrame:
    """Add the 0-based row position inside each series (and the series length as ``length``)."""
    if fits_one_task(df, by):
        w = _series(by)
        place = (F.row_number().over(w.orderBy(*_asc(order))) - 1).cast("long").alias(name)
        return df.select("*", place, *([F.count(F.lit(1)).over(w).alias(length)] if length else []))
    rows = range_slices(df, order, by)
    runs = rows.groupBy(*_slice_key(by)).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = series.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    picked = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")]
    if length:
        picked.append(F.sum("_n").over(series).alias(length))
    runs = runs.select(*_slice_key(by), "_first", *picked)
    out = _join_runs(rows, runs, by).withColumn(name, F.col("_idx") - F.col("_first") + F.col("_before"))
    return out.drop("_slice", "_idx", "_first", "_before")


def with_running_sums(
    df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column | str], by: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums ``name`` and series totals ``name_total`` for every entry of ``sums``."""
    staged = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_v_{k}") for k, c in sums.items()])
    rows = range_slices(staged, order, by)
    runs = rows.groupBy(*_slice_key(by)).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = series.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *_slice_key(by),
        *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(series).alias(f"{k}_total") for k in sums],
    )
    inside = Window.partitionBy(*_slice_key(by)).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        *[c for c in rows.columns if not c.startswith("_v_")],
        *[F.sum(f"_v_{k}").over(inside).alias(f"_l_{k}") for k in sums],
    )
    out = _join_runs(local, runs, by)
    out = out.withColumns({k: F.coalesce(F.col(f"_l_{k}"), F.lit(0)) + F.col(f"_b_{k}") for k in sums})
    return out.drop("_slice", "_idx", *[f"_l_{k}" for k in sums], *[f"_b_{k}" for k in sums])


def with_neighbours(
    df: DataFrame,
    before: int,
    after: int,
    by: Sequence[str] = (),
    pos: str = "_pos",
    block_rows: int = 65536,
) -> tuple[DataFrame, Window, Column]:
    """Cut positioned series into blocks and copy the ``before``/``after`` edge rows into the next/previous block.

    Returns (rows with ``_block``, window over a block, filter that drops the copies). Any row frame that reaches no
    further than ``before`` back and ``after`` ahead gives the same value as over the whole series.
    """
    size = max(block_rows, before, after, 1)
    block = F.floor(F.col(pos) / size).cast("long")
    inside = F.col(pos) % size
    blocks = [block]
    if before:
        blocks.append(F.when(inside >= size - before, block + 1))
    if after:
        blocks.append(F.when((inside < after) & (block > 0), block - 1))
    rows = df.withColumn("_block", F.explode(F.array_compact(F.array(*blocks))))
    window = Window.partitionBy(*by, "_block").orderBy(pos)
    return rows, window, F.col("_block") == block


def carried(
    df: DataFrame,
    order: Sequence[str | Column],
    forward: Mapping[str, Column] | None = None,
    backward: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add the last non-null value up to the row (``forward``) or the first one from the row on (``backward``)."""
    forward, backward = dict(forward or {}), dict(backward or {})
    exprs = {**forward, **backward}
    if fits_one_task(df, by):
        past = _series(by).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
        ahead = _series(by).orderBy(*_desc(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", *[F.last(e, True).over(past).alias(k) for k, e in forward.items()], *[F.last(e, True).over(ahead).alias(k) for k, e in backward.items()]
        )
    rows = range_slices(df.select("*", *[e.alias(f"_v_{k}") for k, e in exprs.items()]), order, by)
    aggs = []
    for k in forward:
        aggs.append(F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col("_idx"))).alias(f"_s_{k}"))
    for k in backward:
        aggs.append(F.min_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col("_idx"))).alias(f"_s_{k}"))
    runs = rows.groupBy(*_slice_key(by)).agg(*aggs)
    series, inside = _series(by), Window.partitionBy(*_slice_key(by))
    to_here, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    runs = runs.select(
        *_slice_key(by),
        *[F.last(f"_s_{k}", True).over(series.orderBy("_slice").rowsBetween(*before)).alias(f"_c_{k}") for k in forward],
        *[F.last(f"_s_{k}", True).over(series.orderBy(F.desc("_slice")).rowsBetween(*before)).alias(f"_c_{k}") for k in backward],
    )
    local = rows.select(
        *[c for c in rows.columns if not c.startswith("_v_")],
        *[F.last(f"_v_{k}", True).over(inside.orderBy("_idx").rowsBetween(*to_here)).alias(f"_l_{k}") for k in forward],
        *[F.last(f"_v_{k}", True).over(inside.orderBy(F.desc("_idx")).rowsBetween(*to_here)).alias(f"_l_{k}") for k in backward],
    )
    out = _join_runs(local, runs, by)
    out = out.withColumns({k: F.coalesce(f"_l_{k}", f"_c_{k}") for k in exprs})
    return out.drop("_slice", "_idx", *[f"_l_{k}" for k in exprs], *[f"_c_{k}" for k in exprs])


def with_suffix_min(df: DataFrame, order: Sequence[str | Column], column: str, output: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the minimum of ``column`` from the row to the end of its series."""
    rows = range_slices(df, order, by)
    series = _series(by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*_slice_key(by)).agg(F.min(column).alias("_m")).select(*_slice_key(by), F.min("_m").over(series).alias("_later"))
    inside = Window.partitionBy(*_slice_key(by)).orderBy(F.desc("_idx")).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.min(column).over(inside))
    out = _join_runs(local, runs, by).withColumn(output, F.least("_local", "_later"))
    return out.drop("_slice", "_idx", "_local", "_later")
