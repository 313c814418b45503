"""Sampling and time-series features. ``order`` is a list of columns that orders a series without ties."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import join_checked
from ..functions.lineage import cut_lineage
from ..functions.moments import from_moments, moment_rows, ols
from ..functions.ordered import framed, with_neighbours, with_position, with_running_sums
from ..functions.pvalues import norm_cdf
from ..functions.quantiles import exact_quantiles

BLOCK_ROWS = 65536


def sample_rows(df: DataFrame, n: int = 10_000, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """At most ``n`` rows chosen by a seeded hash of the key (of all columns by default): the same rows on every run."""
    cols = list(key) or df.columns
    h = F.xxhash64(*[F.col(c).cast("string") for c in cols], F.lit(seed))
    return df.withColumn("_h", h).orderBy("_h", *cols).limit(n).drop("_h")


def sample_with_replacement(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def lag_features(
    df: DataFrame, columns: Sequence[str], lags: Sequence[int], order: Sequence[str], by: Sequence[str] = (),
    drop_nulls: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``{col}_lag{k}``, the value ``k`` rows earlier; ``drop_nulls`` also drops rows with any null."""
    out = framed(df, order, by, max(lags), 0, lambda w: {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags}, block_rows)
    return out.na.drop() if drop_nulls else out


def diff_features(
    df: DataFrame, columns: Sequence[str], orders: Sequence[int], order: Sequence[str], by: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``{col}_diff{k}`` = x_t - x_{t-k}."""
    return framed(df, order, by, max(orders), 0, lambda w: {f"{c}_diff{k}": F.col(c) - F.lag(c, k).over(w) for c in columns for k in orders}, block_rows)


_ROLLING = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    "median": lambda c: F.percentile(c, 0.5),  # the frame holds ``size`` rows
}


def rolling_features(
    df: DataFrame, columns: Sequence[str], sizes: Sequence[int], functions: Sequence[str], order: Sequence[str],
    by: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``{col}_roll{w}_{fn}`` over the last ``w`` rows; null until ``w`` known values are in the frame."""
    def make(w):
        out = {}
        for c in columns:
            for n in sizes:
                frame = w.rowsBetween(-(n - 1), 0)
                for fn in functions:
                    out[f"{c}_roll{n}_{fn}"] = F.when(F.count(c).over(frame) >= n, _ROLLING[fn](F.col(c)).over(frame))
        return out

    return framed(df, order, by, max(sizes) - 1, 0, make, block_rows)


# fixed values: names of the calendar parts
CALENDAR = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "quarter": F.quarter,
    "dayofyear": F.dayofyear, "week": F.weekofyear,
}
CLOCK = {"hour": F.hour, "minute": F.minute, "second": F.second}


def time_features(df: DataFrame, ts: str, parts: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Calendar parts (Monday = 0, ISO week); clock parts only when they vary over the table."""
    fns = {**CALENDAR, **CLOCK}
    if parts is None:
        row = df.agg(*[F.min(f(ts)).alias(f"{k}_lo") for k, f in CLOCK.items()], *[F.max(f(ts)).alias(f"{k}_hi") for k, f in CLOCK.items()]).first()
        parts = [*CALENDAR, *[k for k in CLOCK if row[f"{k}_lo"] != row[f"{k}_hi"]]]
    return df.withColumns({prefix + p: fns[p](ts).cast("int") for p in parts})


# fixed values: strptime letters and their datetime pattern letters
_STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%j": "DDD", "%p": "a", "%I": "hh"}


def parse_datetime(df: DataFrame, column: str, fmt: str | None = None, output: str | None = None) -> DataFrame:
    """Text to timestamp; ``fmt`` in strptime or Spark letters; values that do not parse become null."""
    pattern = fmt
    for k, v in _STRPTIME.items():
        pattern = pattern.replace(k, v) if pattern else pattern
    parsed = F.try_to_timestamp(F.col(column), F.lit(pattern)) if pattern else F.try_to_timestamp(F.col(column))
    return df.withColumn(output or column, parsed.cast("timestamp_ntz"))


def bucket_label(ts: Column, rule: str) -> Column:
    """Date that names the bucket: the day, or the last day of the week, month, quarter or year."""
    if rule == "D":
        return F.to_date(ts)
    if rule == "W":
        return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)
    if rule in ("M", "ME"):
        return F.last_day(ts)
    if rule in ("Q", "QE"):
        return F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", ts)), 2))
    if rule in ("Y", "YE"):
        return F.make_date(F.year(ts), F.lit(12), F.lit(31))
    raise ValueError(f"unknown rule: {rule}")


def _calendar(span: DataFrame, rule: str, by: Sequence[str]) -> DataFrame:
    """Every bucket between the first and the last one of a series: as many rows as the span has buckets."""
    days = F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day")))
    if rule == "D":
        return span.select(*by, days.alias("bucket"))
    if rule == "W":
        return span.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 7 day"))).alias("bucket"))
    months = {"M": 1, "Q": 3, "Y": 12}[rule[0]]
    steps = F.floor(F.round(F.months_between("_hi", "_lo")) / months)
    at = F.explode(F.sequence(F.lit(0), steps.cast("int"))).alias("_k")
    return span.select(*by, "_lo", at).select(*by, F.last_day(F.add_months("_lo", F.col("_k") * months)).alias("bucket"))


def resample(
    df: DataFrame, ts: str, rule: str = "D", method: str = "mean", columns: Sequence[str] | None = None, by: Sequence[str] = (),
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Time buckets of the numeric columns; buckets without rows appear with null (sum: 0).

    ``first`` and ``last`` take known values along ``order`` (default: the time column). Mean, sum, min and max are plain
    aggregations, so the same expression also runs on a stream with a watermark (see ``streaming``).
    """
    cols = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in by])
    rows = df.withColumn("bucket", bucket_label(F.col(ts), rule))
    key = F.struct(*(order or [ts]))
    if method == "median":
        long = exact_quantiles(rows, cols, [0.5], [*by, "bucket"])
        data = long.groupBy(*by, "bucket").agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(c) for c in cols])
    else:
        fns = {
            "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
            "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), key)),
            "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), key)),
        }
        data = rows.groupBy(*by, "bucket").agg(*[fns[method](c).alias(c) for c in cols])
    data = cut_lineage(data)  # read twice below, and much smaller than the input
    span = data.groupBy(*by).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    calendar = _calendar(span.where(F.col("_lo").isNotNull()), rule, by)
    out = calendar.join(data, [*by, "bucket"], "left")
    if method == "sum":
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})
    return out.select(*by, "bucket", *cols)


def seasonal_decompose(
    df: DataFrame, column: str, period: int, order: Sequence[str], by: Sequence[str] = (), model: str = "additive", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``{col}_trend`` (centred moving average, 2×m for an even period), ``_seasonal`` and ``_residual``."""
    half = period // 2
    x = F.col(column).cast("double")
    rows, w, own = with_neighbours(with_position(df, order, by), half, half, by, block_rows=block_rows)
    full = w.rowsBetween(-half, half)
    total = F.sum(x).over(full)
    if period % 2 == 0:  # the two ends count half
        ends = (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2.0
        total = total - ends
    trend = F.when(F.count(x).over(full) == 2 * half + 1, total / period)
    rows = rows.select("*", trend.alias("_trend")).where(own)
    rows = cut_lineage(rows.withColumn("_phase", (F.col("_pos") % period).cast("int")).drop("_block"))
    add = model == "additive"
    detrended = x - F.col("_trend") if add else x / F.col("_trend")
    phases = rows.groupBy(*by, "_phase").agg(F.avg(detrended).alias("_raw"))
    centre = F.avg("_raw").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))  # ``period`` rows
    phases = phases.select(*by, "_phase", (F.col("_raw") - centre if add else F.col("_raw") / centre).alias("_seasonal"))
    joined = rows.join(phases if by else F.broadcast(phases), [*by, "_phase"], "left")
    rest = x - F.col("_trend") - F.col("_seasonal") if add else x / (F.col("_trend") * F.col("_seasonal"))
    return joined.select(
        *df.columns, F.col("_trend").alias(f"{column}_trend"), F.col("_seasonal").alias(f"{column}_seasonal"), rest.alias(f"{column}_residual")
    )


# fixed values: response surface of MacKinnon (1994) for one series with a constant
_ADF_SMALL = [2.1659, 1.4412, 0.038269]
_ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
_ADF_STAR, _ADF_MIN, _ADF_MAX = -1.61, -18.83, 2.74
# fixed values: KPSS critical values, level stationarity
_KPSS_CRITICAL = [0.347, 0.463, 0.574, 0.739]
_KPSS_P = [0.10, 0.05, 0.025, 0.01]


def adf_p(stat: float) -> float:
    if stat > _ADF_MAX:
        return 1.0
    if stat < _ADF_MIN:
        return 0.0
    coefs = _ADF_SMALL if stat <= _ADF_STAR else _ADF_LARGE
    return norm_cdf(sum(c * stat**i for i, c in enumerate(coefs)))


def kpss_p(stat: float) -> float:
    return float(np.interp(stat, _KPSS_CRITICAL, _KPSS_P))


def stationarity_adf(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), max_lag: int | None = None) -> DataFrame:
    """(by…, statistic, p_value, lags, n): augmented Dickey-Fuller with constant, lag length by AIC."""
    known = df.where(F.col(column).isNotNull()).select(*dict.fromkeys([*by, *order, column]))
    if max_lag is None:
        # each series has its own limit; series with the same limit (a slow function of the length, so a few values) are done together
        n = F.col("_n")
        limit = F.greatest(F.least(F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))).cast("int"), (F.floor(n / 2) - 2).cast("int")), F.lit(0))
        limits = cut_lineage(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, limit.alias("_limit")))
        parts = []
        for r in limits.select("_limit").distinct().orderBy("_limit").collect():
            own = limits.where(F.col("_limit") == r["_limit"])
            series = join_checked(known, own, list(by)).drop("_limit") if by else known
            parts.append(stationarity_adf(series, column, order, by, r["_limit"]))
        if not parts:
            return stationarity_adf(known, column, order, by, 0)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    rows, w, own = with_neighbours(with_position(known, order, by), max_lag + 1, 0, by)
    x = F.col(column).cast("double")
    lagged = rows.select(
        *by, own.alias("_own"), (x - F.lag(x).over(w)).alias("d0"), F.lag(x).over(w).alias("level"),
        *[(F.lag(x, k).over(w) - F.lag(x, k + 1).over(w)).alias(f"d{k}") for k in range(1, max_lag + 1)],
    ).where("_own")
    lagged = cut_lineage(lagged)
    names = ["d0", "level", *[f"d{k}" for k in range(1, max_lag + 1)]]

    def aic(n, means, cov):
        best = None
        for k in range(max_lag + 1):
            fit = ols(n, means, cov, 0, [1, *range(2, 2 + k)])
            crit = n * math.log(fit["rss"] / n) + 2 * (k + 2) if fit["rss"] > 0 else -math.inf
            if best is None or crit < best[0]:
                best = (crit, k)
        return [{"lags": best[1]}]

    chosen = from_moments(moment_rows(lagged, names, by), aic, "lags int", by)

    # refit on every row that the chosen lag length leaves usable
    fits = None
    for k in range(max_lag + 1):
        used = names[: 2 + k]

        def stat(n, means, cov, k=k):
            fit = ols(n, means, cov, 0, list(range(1, 2 + k)))
            t = float(fit["t"][1])
            return [{"lags": k, "statistic": t, "p_value": adf_p(t), "n": int(n)}]

        part = (k, used, stat)
        fits = [*(fits or []), part]
    picked = sorted({r.lags for r in chosen.select("lags").distinct().collect()})
    out = None
    for k, used, stat in fits:
        if k not in picked:
            continue
        group = lagged.join(chosen.where(F.col("lags") == k), list(by), "left_semi") if by else lagged
        one = from_moments(moment_rows(group, used, by), stat, "lags int, statistic double, p_value double, n long", by)
        out = one if out is None else out.unionByName(one)
    return out


def stationarity_kpss(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), lags: int | None = None) -> DataFrame:
    """(by…, statistic, p_value, lags, n): KPSS for level stationarity with Bartlett weights; ``lags=None`` picks them
    from the autocovariances (Hobijn et al.)."""
    known = df.where(F.col(column).isNotNull()).select(*dict.fromkeys([*by, *order]), F.col(column).cast("double").alias("_x"))
    means = known.groupBy(*by).agg(F.avg("_x").alias("_mean"), F.count("_x").alias("_len"))
    if by:
        known = known.join(means, list(by))
    else:
        m, n = means.first()
        known = known.withColumns({"_mean": F.lit(m), "_len": F.lit(n)})
    known = known.withColumn("_e", F.col("_x") - F.col("_mean"))
    longest = known.agg(F.max("_len")).first()[0] or 1
    reach = lags if lags is not None else int(math.ceil(12.0 * (longest / 100.0) ** 0.25)) + int(longest ** (2.0 / 9.0)) + int(4 * longest ** (1.0 / 3.0))
    reach = max(reach, 1)
    summed = with_running_sums(known, order, {"_s": F.col("_e")}, by)
    rows, w, own = with_neighbours(with_position(summed, order, by), reach, 0, by)
    prods = rows.select(*by, own.alias("_own"), "_e", "_s", *[(F.col("_e") * F.lag("_e", k).over(w)).alias(f"g{k}") for k in range(1, reach + 1)]).where("_own")
    stats = prods.groupBy(*by).agg(
        F.count("_e").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("ss"), F.sum(F.col("_e") * F.col("_e")).alias("g0"),
        *[F.coalesce(F.sum(f"g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(1, reach + 1)],
    )
    gs = F.array(*[F.col(f"g{k}") for k in range(0, reach + 1)])
    n = F.col("n").cast("double")
    if lags is not None:
        lag = F.lit(lags)
    else:
        first = F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int")
        head = F.slice("_g", F.lit(2), first)
        s0 = F.col("g0") / n + F.aggregate(F.transform(head, lambda g: 2.0 * g / n), F.lit(0.0), lambda a, b: a + b)
        s1 = F.aggregate(F.transform(head, lambda g, i: 2.0 * g / n * (i + 1)), F.lit(0.0), lambda a, b: a + b)
        gamma = 1.1447 * F.pow(F.pow(s1 / s0, 2), F.lit(1.0 / 3.0))
        lag = F.least(F.floor(gamma * F.pow(n, F.lit(1.0 / 3.0))).cast("int"), (n - 1).cast("int"), F.lit(reach))
    stats = stats.withColumn("_g", gs).withColumn("lags", lag.cast("int"))
    weighted = F.aggregate(
        F.transform(F.slice("_g", F.lit(2), F.col("lags")), lambda g, i: g * (1.0 - (i + 1) / (F.col("lags") + 1.0))), F.lit(0.0), lambda a, b: a + b
    )
    stat = (F.col("ss") / (n * n)) / ((F.col("g0") + 2.0 * weighted) / n)
    out = stats.select(*by, stat.alias("statistic"), "lags", "n")
    p = F.lit(_KPSS_P[0])
    for (c0, p0), (c1, p1) in zip(zip(_KPSS_CRITICAL, _KPSS_P), zip(_KPSS_CRITICAL[1:], _KPSS_P[1:])):
        p = F.when(F.col("statistic") > c0, F.greatest(F.lit(p0) + (F.col("statistic") - c0) / (c1 - c0) * (p1 - p0), F.lit(p1))).otherwise(p)
    return out.withColumn("p_value", p)


def stationarity_verdict(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Joint reading of both tests."""
    a = stationarity_adf(df, column, order, by).select(*by, F.col("p_value").alias("adf_p"))
    k = stationarity_kpss(df, column, order, by).select(*by, F.col("p_value").alias("kpss_p"))
    both = a.join(k, list(by)) if by else a.withColumn("_k", F.lit(0)).join(k.withColumn("_k", F.lit(0)), "_k").drop("_k")
    adf, kpss = F.col("adf_p") < alpha, F.col("kpss_p") > alpha
    return both.withColumn(
        "verdict",
        F.when(adf & kpss, "Stationary").when(~adf & ~kpss, "Non-stationary").when(adf, "Trend stationary").otherwise("Difference stationary"),
    )
