"""Scaling, encoding and binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import row_bound
from ..functions.ordered import with_position
from ..functions.quantiles import collect_quantiles

BROADCAST_ROWS = 100_000  # category tables up to this many rows are broadcast, longer ones joined by shuffle


def _moments(df: DataFrame, cols: Sequence[str], *fns) -> dict[str, list]:
    row = df.agg(*[fn(F.col(c).cast("double")).alias(f"{c}_{i}") for c in cols for i, fn in enumerate(fns)]).first()
    return {c: [row[f"{c}_{i}"] for i in range(len(fns))] for c in cols}


def _rescaled(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """(x - centre) / width per column; a zero width only centres."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(float(s) if s else 1.0) for c, (m, s) in bounds.items() if m is not None}
    )


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std."""
    return _rescaled(df, {c: tuple(v) for c, v in _moments(df, columns, F.avg, F.stddev_pop).items()})


def scale_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = _moments(df, columns, F.min, F.max)
    return _rescaled(df, {c: (lo, None if lo is None else hi - lo) for c, (lo, hi) in stats.items()})


def scale_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range, both exact."""
    qs = collect_quantiles(df, columns, [0.25, 0.5, 0.75])
    return _rescaled(df, {c: (q[1], None if q[1] is None else q[2] - q[0]) for c, q in qs.items()})


def encode_onehot(
    df: DataFrame, columns: Sequence[str], drop_first: bool = False, max_values: int = 1000, keep: bool = False
) -> DataFrame:
    """0/1 column ``{col}_{value}`` per distinct value, in value order; columns with more values are refused."""
    for c in columns:
        values = df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_values + 1).collect()
        if len(values) > max_values:
            raise ValueError(f"{c} has more than {max_values} values; use encode_label")
        ordered = sorted(r[0] for r in values)[1 if drop_first else 0:]
        df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in ordered})
        if not keep:
            df = df.drop(c)
    return df


def _join_codes(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    small = row_bound(codes, BROADCAST_ROWS) <= BROADCAST_ROWS
    return df.join(F.broadcast(codes) if small else codes, column, "left")


def category_codes(df: DataFrame, column: str, output: str) -> DataFrame:
    """0-based rank of the value among the sorted distinct values; missing stays missing."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = with_position(values, [column], name="_code").select(column, F.col("_code").cast("int").alias("_code"))
    joined = _join_codes(df, codes, column)
    keep = [c for c in df.columns if c != output]
    return joined.select(*keep, F.col("_code").alias(output))


def encode_label(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """New column ``{col}_label``."""
    for c in columns:
        df = category_codes(df, c, f"{c}_label")
    return df


def encode_ordinal(
    df: DataFrame, column: str, categories: Sequence | None = None, order_col: str | Sequence[str] | None = None, output: str | None = None
) -> DataFrame:
    """Position in ``categories``; without it, order of first appearance along ``order_col``. Unknown values get null."""
    name = output or f"{column}_ordinal"
    if categories is not None:
        lookup = F.create_map(*[F.lit(x) for i, v in enumerate(categories) for x in (v, i)])
        return df.withColumn(name, F.try_element_at(lookup, F.col(column)))
    if order_col is None:
        raise ValueError("give categories or order_col")
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_f"))
    codes = with_position(first, ["_f", column], name="_code").select(column, F.col("_code").cast("int").alias("_code"))
    joined = _join_codes(df, codes, column)
    return joined.select(*[c for c in df.columns if c != name], F.col("_code").alias(name))


def _above(column: str, edges: Sequence[float]):
    """Number of edges below the value: right-closed bins."""
    code = F.lit(0)
    for e in edges:
        code = code + (F.col(column) > F.lit(float(e))).cast("int")
    return code


def bin_uniform(df: DataFrame, column: str, num_bins: int = 5, labels: Sequence[str] | None = None) -> DataFrame:
    """0-based equal-width bin ``{col}_binned``; bins are right-closed and the minimum falls in the first."""
    lo, hi = _moments(df, [column], F.min, F.max)[column]
    edges = [] if lo is None else [lo + (hi - lo) * i / num_bins for i in range(1, num_bins)]
    return _labelled(df, column, _above(column, edges), labels)


def bin_quantile(df: DataFrame, column: str, num_bins: int = 5, labels: Sequence[str] | None = None) -> DataFrame:
    """Bin by exact quantile edges, right-closed; equal edges merge."""
    edges = collect_quantiles(df, [column], [i / num_bins for i in range(num_bins + 1)])[column]
    inner = sorted({e for e in edges if e is not None})[1:-1]
    return _labelled(df, column, _above(column, inner), labels)


def bin_kmeans(df: DataFrame, column: str, num_bins: int = 5, labels: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """Bins are 1-D k-means clusters numbered by their centre."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"))
    vec = VectorAssembler(inputCols=["_x"], outputCol="_f")
    model = KMeans(k=num_bins, seed=seed, featuresCol="_f", predictionCol="_p").fit(vec.transform(known))
    centres = sorted(float(c[0]) for c in model.clusterCenters())
    # on a line the nearest centre changes at the midpoints
    mids = [(a + b) / 2.0 for a, b in zip(centres, centres[1:])]
    return _labelled(df, column, _above(column, mids), labels)


def _labelled(df: DataFrame, column: str, code, labels: Sequence[str] | None) -> DataFrame:
    value = code if labels is None else F.element_at(F.array(*[F.lit(x) for x in labels]), code + 1)
    return df.withColumn(f"{column}_binned", value)


def group_codes(df: DataFrame, column: str, output: str = "group_code") -> DataFrame:
    """Code of a time or domain column by sorted value."""
    return category_codes(df, column, output)


def segments(df: DataFrame, order: Sequence[str], n: int = 4, output: str = "segment") -> DataFrame:
    """``n`` segments of equal length along the order; the last one takes the remainder (all rows, if there are fewer than ``n``)."""
    rows = with_position(df, order, length="_len")
    size = F.floor(F.col("_len") / n)
    code = F.when(size > 0, F.least(F.floor(F.col("_pos") / F.greatest(size, F.lit(1))), F.lit(n - 1))).otherwise(n - 1)
    return rows.withColumn(output, code.cast("int")).drop("_pos", "_len")


def period_codes(df: DataFrame, ts: str, output: str = "period") -> DataFrame:
    """Year when the span is over two years, month when over three months, otherwise week number from the start."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        return df.withColumn(output, F.lit(None).cast("int"))
    days = (hi - lo).days
    if days > 730:
        code = F.year(ts)
    elif days > 90:
        code = F.year(ts) * 12 + F.month(ts)
    else:
        code = F.floor(F.datediff(F.col(ts), F.lit(lo)) / 7)
    return df.withColumn(output, code.cast("int"))
