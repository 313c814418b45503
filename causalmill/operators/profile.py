"""Column and table profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import join_checked, zip_single_rows
from ..functions.lineage import cut_lineage
from ..functions.ordered import with_position, with_running_sums
from ..functions.pvalues import norm_cdf_col
from ..functions.quantiles import exact_quantiles, modes, unpivot, value_counts_long

QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def profile_var_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, var_type, distinct, known): binary, discrete, continuous, categorical, datetime or unknown."""
    cols = list(columns or df.columns)
    typed = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in cols if isinstance(typed[c], (T.NumericType, T.BooleanType))]
    times = [c for c in cols if isinstance(typed[c], _TIME_TYPES)]
    counts = value_counts_long(df, cols, as_type="string")
    whole = F.bool_and(F.col("value").try_cast("double") == F.floor(F.col("value").try_cast("double")))
    stats = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("known"), whole.alias("_whole"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    full = names.join(stats, "column", "left").na.fill(0, ["distinct", "known"])
    d, n = F.col("distinct"), F.col("known")
    is_num, is_time = F.col("column").isin(numeric), F.col("column").isin(times)
    if_bool = F.col("column").isin([c for c in numeric if isinstance(typed[c], T.BooleanType)])
    kind = (
        F.when(is_time, "datetime")
        .when(is_num & (n == 0), "unknown")
        .when(d <= 2, "binary")
        .when(if_bool, "binary")
        .when(is_num & F.col("_whole") & ((d <= 10) | (d / n < 0.05)), "discrete")
        .when(is_num, "continuous")
        .otherwise("categorical")
    )
    return full.select("column", kind.alias("var_type"), "distinct", "known")


def overall_type(types: DataFrame) -> DataFrame:
    """One row: counts per type and the overall type (80 % rule)."""
    kinds = ["continuous", "discrete", "binary", "categorical", "datetime", "unknown"]
    row = types.agg(F.count(F.lit(1)).alias("n_features"), *[F.count(F.when(F.col("var_type") == k, 1)).alias(f"n_{k}") for k in kinds])
    p = F.col("n_features")
    disc = F.col("n_discrete") + F.col("n_binary") + F.col("n_categorical")
    return row.withColumn(
        "overall_type",
        F.when(F.col("n_continuous") == p, "continuous").when(F.col("n_continuous") >= 0.8 * p, "mostly_continuous")
        .when(disc == p, "discrete").when(disc >= 0.8 * p, "mostly_discrete").otherwise("mixed"),
    )


def profile_overall(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: type counts, overall type and distribution, sample sufficiency and size judgments."""
    cols = list(columns or df.columns)
    types = cut_lineage(profile_var_types(df, cols))
    cont = [r["column"] for r in types.where("var_type = 'continuous'").select("column").collect()]
    base = overall_type(types)
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if cont:
        dist = profile_normality(df, cont).agg(
            F.count(F.lit(1)).alias("n_tested"), F.count(F.when(F.col("distribution") == "gaussian", 1)).alias("n_gaussian"),
            F.count(F.when(F.col("distribution") == "skewed_non_gaussian", 1)).alias("n_skewed"),
            F.count(F.when(F.col("distribution") == "heavy_tailed", 1)).alias("n_heavy"),
        )
    else:
        dist = df.sparkSession.createDataFrame([(0, 0, 0, 0)], "n_tested long, n_gaussian long, n_skewed long, n_heavy long")
    one = zip_single_rows(base, rows, dist)
    share = F.try_divide(F.col("n_gaussian"), F.col("n_tested"))
    n, p = F.col("n_rows"), F.col("n_features")
    return one.withColumns({
        "overall_distribution": F.when(F.col("n_tested") == 0, "unknown").when(share > 0.8, "gaussian").when(share > 0.5, "mostly_gaussian")
        .when(F.col("n_skewed") > F.col("n_heavy"), "skewed").when(F.col("n_heavy") > 0, "heavy_tailed").otherwise("non_gaussian"),
        "enough_parametric": n >= 30,
        "enough_nonparametric": n >= 100,
        "enough_structure": n >= F.greatest(F.lit(30).cast("long"), 10 * p),
        "enough_nonlinear": n >= 200,
        "enough_high_dimensional": n >= 20 * p,
        "enough_series": n >= 50,
    })


def profile_numeric_stats(df: DataFrame, columns: Sequence[str], discrete: bool = False) -> DataFrame:
    """Moments, exact quantiles and, for discrete columns, mode, entropy and distinct count; one row per column."""
    cols = list(columns)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    fns = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": F.skewness, "kurtosis": F.kurtosis,
    }
    wide = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in fns.items()])
    recs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in fns]) for i, c in enumerate(cols)]
    moments = wide.select(F.inline(F.array(*recs))).withColumn("range", F.col("max") - F.col("min"))
    qs = exact_quantiles(df, cols, QUANTILES)
    names = {f"q{i}": f"q{int(q * 100)}" for i, q in enumerate(QUANTILES)}
    qs = qs.select("column", *[F.col(a).alias(f"_{b}") for a, b in names.items()])
    out = moments.join(F.broadcast(qs), "column", "left")
    out = out.select(*moments.columns, F.col("_q50").alias("median"), (F.col("_q75") - F.col("_q25")).alias("iqr"), *[F.col(f"_{b}").alias(b) for b in names.values()])
    if discrete:
        cat = profile_categorical_stats(df, cols).select("column", F.col("unique_values"), F.col("entropy"))
        mode = modes(df, cols).select("column", F.col("value").alias("mode"))
        out = out.join(cat, "column", "left").join(mode, "column", "left")
    return out


def _ranked_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_counts_long(df, columns, as_type="string")


def profile_categorical_stats(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(column, known, unique_values, most_common, most_common_percentage, entropy, top_values, top_counts)."""
    counts = cut_lineage(_ranked_counts(df, columns))
    total = counts.groupBy("column").agg(F.sum("n").alias("known"), F.count(F.lit(1)).alias("unique_values"))
    p = F.col("n") / F.col("known")
    stats = counts.join(F.broadcast(total), "column").groupBy("column", "known", "unique_values").agg((-F.sum(p * F.log(p))).alias("entropy"))
    best = top_values(counts, top).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
    out = stats.join(F.broadcast(best), "column")
    first = F.element_at("t", 1)
    return out.select(
        "column", "known", "unique_values", first["value"].alias("most_common"),
        (F.lit(100.0) * first["n"] / F.col("known")).alias("most_common_percentage"), "entropy",
        F.col("t.value").alias("top_values"), F.col("t.n").alias("top_counts"),
    )


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """(column, value, n, rank): the ``k`` most frequent values per column; every task hands on at most ``k`` rows."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def profile_datetime_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min_date, max_date, range_days, unique_dates, first_year, last_year, most_common_year, most_common_month)."""
    ts = unpivot(df, columns, as_type="timestamp_ntz").where(F.col("value").isNotNull())
    # one row per distinct value; parts are counted from these
    counts = cut_lineage(ts.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    base = counts.groupBy("column").agg(F.min("value").alias("min_date"), F.max("value").alias("max_date"), F.count(F.lit(1)).alias("unique_dates"))

    def common(part, name):
        per = counts.groupBy("column", part("value").alias("v")).agg(F.sum("n").alias("n"))
        return per.groupBy("column").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(name))

    out = base.join(common(F.year, "most_common_year"), "column").join(common(F.month, "most_common_month"), "column")
    days = F.floor((F.unix_micros(F.col("max_date").cast("timestamp")) - F.unix_micros(F.col("min_date").cast("timestamp"))) / 86_400_000_000)
    return out.select(
        "column", "min_date", "max_date", days.cast("long").alias("range_days"), "unique_dates",
        F.year("min_date").alias("first_year"), F.year("max_date").alias("last_year"), "most_common_year", "most_common_month",
    )


def datetime_counts(df: DataFrame, column: str) -> DataFrame:
    """(part, value, n): rows per year, month and weekday (Monday = 0)."""
    parts = {"year": F.year, "month": F.month, "weekday": F.weekday}
    recs = F.array(*[F.struct(F.lit(k).alias("part"), f(column).alias("value")) for k, f in parts.items()])
    return df.where(F.col(column).isNotNull()).select(F.inline(recs)).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


# fixed values: name parts that mark a time column
TIME_NAMES = ["time", "date", "year", "month", "day", "hour", "minute", "second", "timestamp", "period", "week", "quarter"]


def profile_temporal(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, by_type, by_name, constant_step): time-like columns; ``constant_step`` says that the sorted distinct values
    of a time or number column are evenly spaced."""
    cols = list(columns or df.columns)
    by_type = {c for c in cols if isinstance(df.schema[c].dataType, _TIME_TYPES)}
    by_name = {c for c in cols if any(t in c.lower() for t in TIME_NAMES)}
    found = [c for c in cols if c in by_type | by_name]
    spark = df.sparkSession
    rows = spark.createDataFrame([(c, c in by_type, c in by_name) for c in found], "column string, by_type boolean, by_name boolean")
    able = [c for c in found if c in by_type or isinstance(df.schema[c].dataType, T.NumericType)]
    if not able:
        return rows.withColumn("constant_step", F.lit(None).cast("boolean"))
    # evenly spaced <=> the value at position k is min + k * (max - min) / (m - 1)
    numbers = df.select(*[(F.unix_micros(F.col(c).cast("timestamp")) if c in by_type else F.col(c)).cast("double").alias(c) for c in able])
    distinct = value_counts_long(numbers, able)
    pos = with_position(distinct, ["value"], ["column"], length="_m")
    ends = pos.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    joined = pos.join(F.broadcast(ends), "column")
    ideal = F.col("_lo") + F.col("_pos") * (F.col("_hi") - F.col("_lo")) / F.greatest(F.col("_m") - 1, F.lit(1))
    step = (F.col("_hi") - F.col("_lo")) / F.greatest(F.col("_m") - 1, F.lit(1))
    even = joined.groupBy("column").agg((F.bool_and(F.abs(F.col("value") - ideal) <= 1e-6 * F.greatest(step, F.lit(1e-12))) & (F.max("_m") > 2)).alias("constant_step"))
    return rows.join(F.broadcast(even), "column", "left")


@F.pandas_udf(T.DoubleType())
def dagostino_k2(n: pd.Series, skew: pd.Series, kurt: pd.Series) -> pd.Series:
    """D'Agostino-Pearson K² from population skewness and excess kurtosis (chi-square with 2 degrees under normality)."""
    n = n.astype(float)
    y = skew * np.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + np.sqrt(2 * (beta2 - 1))
    a = y / np.sqrt(2.0 / (w2 - 1))
    z1 = np.log(a + np.sqrt(a * a + 1)) / np.sqrt(0.5 * np.log(w2))
    expected = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / np.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * np.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    big = 6.0 + 8.0 / b1 * (2.0 / b1 + np.sqrt(1 + 4.0 / (b1 * b1)))
    root = np.cbrt((1 - 2 / big) / (1 + x * np.sqrt(2.0 / (big - 4))))
    z2 = (1 - 2 / (9 * big) - root) / np.sqrt(2 / (9 * big))
    return z1 * z1 + z2 * z2


def profile_normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, skew, kurtosis, k2, k2_p, jb_p, anderson, anderson_critical, distribution).

    Gaussian when D'Agostino, Anderson-Darling and Jarque-Bera all accept at 5 %; a constant column is unknown; otherwise non_gaussian,
    skewed_non_gaussian (|skew| > 1) or heavy_tailed (excess kurtosis > 2). Under 8 rows: unknown.
    """
    cols = list(columns)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    fns = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "skew": F.skewness, "kurtosis": F.kurtosis}
    wide = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in fns.items()])
    recs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in fns]) for i, c in enumerate(cols)]
    st = cut_lineage(wide.select(F.inline(F.array(*recs))))
    counts = value_counts_long(rows, cols).withColumnRenamed("n", "c")
    run = with_running_sums(counts, ["value"], {"cum": F.col("c")}, ["column"]).join(F.broadcast(st), "column")
    f = norm_cdf_col(F.try_divide(F.col("value") - F.col("mean"), F.col("sd")))
    lo, hi = F.lit(1e-300), F.lit(1.0 - 1e-16)
    run = run.withColumn("_f", F.least(F.greatest(f, lo), hi))
    a, c, n = F.col("cum") - F.col("c"), F.col("c"), F.col("n").cast("double")
    term = c * (2 * a + c) * F.log("_f") + c * (2 * n - 2 * a - c) * F.log(1 - F.col("_f"))
    ad = run.groupBy("column").agg((-F.max(n) - F.sum(term) / F.max(n)).alias("anderson"))
    out = st.join(F.broadcast(ad), "column", "left")
    nn = F.col("n").cast("double")
    out = out.withColumn("k2", F.when(F.col("n") >= 8, dagostino_k2(nn, "skew", "kurtosis")))
    jb = nn / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    out = out.withColumns({
        "k2_p": F.exp(-F.col("k2") / 2), "jb_p": F.exp(-jb / 2),
        "anderson_critical": F.round(0.787 / (1 + 4.0 / nn - 25.0 / (nn * nn)), 3),
    })
    ok = (F.col("k2_p") > 0.05) & (F.col("anderson") < F.col("anderson_critical")) & (F.col("jb_p") > 0.05)
    label = (
        F.when((F.col("n") < 8) | ~(F.col("sd") > 0), "unknown").when(ok, "gaussian").when(F.col("kurtosis") > 2, "heavy_tailed")
        .when(F.abs("skew") > 1, "skewed_non_gaussian").otherwise("non_gaussian")
    )
    return out.select("column", "n", "skew", "kurtosis", "k2", "k2_p", "jb_p", "anderson", "anderson_critical", label.alias("distribution"))


def _bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)], *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None}


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin, left-closed, the maximum in the last bin."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)).cast("int"), F.lit(bins - 1))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """(column, bin, low, high, n) of equal-width bins, empty bins included."""
    bounds = _bounds(df, columns)
    recs = [F.struct(F.lit(c).alias("column"), _bin(F.col(c).cast("double"), lo, hi, bins).alias("bin")) for c, (lo, hi) in bounds.items()]
    found = df.select(F.inline(F.array(*recs))).where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    frame = spark.createDataFrame(
        [(c, b, lo + (hi - lo) * b / bins, lo + (hi - lo) * (b + 1) / bins) for c, (lo, hi) in bounds.items() for b in range(bins)],
        "column string, bin int, low double, high double",
    )
    return frame.join(found, ["column", "bin"], "left").na.fill(0, ["n"])


def kde(df: DataFrame, column: str, points: int = 200, bins: int = 1000) -> DataFrame:
    """(x, density): Gaussian kernel curve (Scott's bandwidth) on binned counts; one scan, then ``points * bins`` terms."""
    (lo, hi), = _bounds(df, [column]).values()
    n, sd = df.agg(F.count(column), F.stddev_samp(column)).first()
    h = (sd or 1.0) * n ** (-0.2) or 1.0
    hist = histogram(df, [column], bins).select(((F.col("low") + F.col("high")) / 2).alias("m"), F.col("n").cast("double").alias("n"))
    packed = hist.agg(F.collect_list(F.struct("m", "n")).alias("h"))  # ``bins`` cells
    grid = packed.select("h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))
    grid = grid.withColumn("x", x)
    total = F.aggregate(
        "h", F.lit(0.0), lambda a, c: a + c["n"] * F.exp(-0.5 * F.pow((F.col("x") - c["m"]) / F.lit(h), 2))
    )
    return grid.select("x", (total / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 49) -> DataFrame:
    """(x_bin, y_bin, n) of the cells that occur."""
    b = _bounds(df, [x, y])
    cells = df.select(_bin(F.col(x).cast("double"), *b[x], bins).alias("x_bin"), _bin(F.col(y).cast("double"), *b[y], bins).alias("y_bin"))
    return cells.na.drop().groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """(by…, n, mean, q1, median, q3, whisker_low, whisker_high, outliers): whiskers reach the last row inside the fences."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    qs = exact_quantiles(rows, ["_x"], [0.25, 0.5, 0.75], by).select(*by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    if by:
        joined = join_checked(rows, qs, by)
    else:
        q = qs.first()
        joined = rows.withColumns({k: F.lit(q[k] if q else None).cast("double") for k in ("q1", "median", "q3")})
    lo = F.col("q1") - factor * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    inside = (F.col("_x") >= lo) & (F.col("_x") <= hi)
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"), F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def outlier_points(df: DataFrame, value: str, box: DataFrame, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """Rows outside the fences of ``box_stats``."""
    fences = box.select(*by, (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("_lo"), (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("_hi"))
    if by:
        joined = join_checked(df, fences, by)
    else:
        f = fences.first()
        joined = df.withColumns({"_lo": F.lit(f._lo), "_hi": F.lit(f._hi)})
    return joined.where((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).drop("_lo", "_hi")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def group_mean(df: DataFrame, values: Sequence[str], group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])


def crosstab(df: DataFrame, a: str, b: str, wide_values: Sequence | None = None) -> DataFrame:
    """(a, b, n), or one column per value of ``b`` when ``wide_values`` names them."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if wide_values is None:
        return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(a).pivot(b, list(wide_values)).agg(F.count(F.lit(1))).na.fill(0)


def data_summary_text(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(summary): one line per variable with its statistics and one per strong correlation, as text for a prompt."""
    from .association import pair_stats

    cols = list(columns)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    wide = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))])
    lines = [
        F.format_string(f"{c}: mean=%.2f, std=%.2f, min=%.2f, max=%.2f", F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"))
        for i, c in enumerate(cols)
    ]
    stats = wide.select(F.array_join(F.array(*lines), "\n").alias("stats"))
    strong = pair_stats(df, cols).where(F.abs("r") >= threshold)
    text = F.format_string("%s and %s: %.2f", F.col("x"), F.col("y"), F.col("r"))
    corr = strong.select("x", "y", text.alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "t"))), lambda s: s["t"]), "\n").alias("corr"))
    both = zip_single_rows(stats, corr)
    tail = F.when(F.col("corr") == "", "none").otherwise(F.col("corr"))
    return both.select(F.concat(F.lit("Variables:\n"), F.col("stats"), F.lit("\nStrong correlations:\n"), tail).alias("summary"))
