"""Correlation, dependence and group tests."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import zip_single_rows
from ..functions.lineage import cut_lineage
from ..functions.moments import complete_rows, correlation, feature_moments, from_moments, moment_rows, ols, partial_correlation
from ..functions.ordered import range_slices, with_position, with_running_sums, with_suffix_min
from ..functions.pvalues import chi2_p, f_p, gamma_q, ks_p, norm_two_sided_p, t_p, t_quantile, t_two_sided
from .scaling import _moments

_SQL_PAIRS, _SQL_PAIRS_BY = 6, 15  # more pairs than this outgrow one compiled aggregation
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(cols, 2))


def pair_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, x, y, n, r, cov) for every column pair over the rows that know both."""
    rows = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])  # NaN counts as unknown
    pairs = _pairs(cols)
    if len(pairs) > (_SQL_PAIRS_BY if by else _SQL_PAIRS):
        return _pair_stats_wide(rows, list(cols), list(by))
    aggs = []
    for i, (x, y) in enumerate(pairs):
        known = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.count(F.when(known, 1)).alias(f"n{i}")]
        aggs += [F.var_pop(F.when(known, F.col(v))).alias(f"v{a}{i}") for a, v in (("x", x), ("y", y))]
        aggs += [F.avg(F.when(known, F.col(v) * F.col(v))).alias(f"q{a}{i}") for a, v in (("x", x), ("y", y))]
    wide = rows.groupBy(*by).agg(*aggs)
    recs = [
        F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"),
            _r(F.col(f"c{i}"), F.col(f"vx{i}"), F.col(f"vy{i}"), F.col(f"qx{i}"), F.col(f"qy{i}")).alias("r"),
            F.when(F.col(f"n{i}") > 1, F.col(f"c{i}") * F.col(f"n{i}") / (F.col(f"n{i}") - 1)).alias("cov"),
        )
        for i, (x, y) in enumerate(pairs)
    ]
    return wide.select(*by, F.inline(F.array(*recs)))


#: A variance of less than this share of the mean square is rounding: the column is constant.
_CONSTANT = 1e-13


def _r(cov: Column, vx: Column, vy: Column, qx: Column, qy: Column) -> Column:
    """Correlation, null where a column is constant."""
    r = F.greatest(F.least(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)), F.lit(1.0)), F.lit(-1.0))
    return F.when((vx > qx * _CONSTANT) & (vy > qy * _CONSTANT), r)


def _pair_stats_wide(rows: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Many pairs: with M the known-flags and X the values (0 where unknown), M'M, X'M, (X*X)'M and X'X hold the sums of
    every pair. Each task adds them over its batches; p(p-1)/2 rows per task (and group) are shuffled."""
    shift = np.array([v or 0.0 for v in rows.agg(*[F.avg(c) for c in cols]).first()], dtype=float)  # NaN has become null
    lo, hi = np.triu_indices(len(cols), 1)
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in ("i", "j")] + [T.StructField(c, T.DoubleType()) for c in _SUMS])

    def rows_of(total: dict) -> Iterator[pd.DataFrame]:
        for key, part in total.items():
            out = pd.DataFrame({"i": lo.astype(np.int32), "j": hi.astype(np.int32), **dict(zip(_SUMS, part))})
            for k, v in zip(by, key if isinstance(key, tuple) else (key,)):
                out[k] = v
            yield out[[*by, "i", "j", *_SUMS]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            if len(total) > 5000:  # groups held at once
                yield from rows_of(total)
                total = {}
            for key, g in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
                x = g[cols].to_numpy(dtype=float) - shift
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x, nan=0.0)
                n, s, q, c = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
                part = np.stack([n[lo, hi], s[lo, hi], s[hi, lo], q[lo, hi], q[hi, lo], c[lo, hi]])
                total[key] = total[key] + part if key in total else part
        yield from rows_of(total)

    st = rows.mapInPandas(partial, schema).groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    sxy = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx, vy = (F.greatest(F.col(f"s{v}{v}") - F.try_divide(F.col(f"s{v}") * F.col(f"s{v}"), n), F.lit(0.0)) for v in "xy")
    names = F.array(*[F.lit(c) for c in cols])
    r = _r(sxy, vx, vy, F.col("sxx"), F.col("syy"))
    return st.select(
        *by, F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), n.cast("long").alias("n"),
        r.alias("r"), F.when(n > 1, sxy / (n - 1)).alias("cov"),
    )


def corr_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, one column per variable): Pearson over pairwise complete rows."""
    long = pair_stats(df, columns, by).select(*by, "x", "y", "r")
    both = long.unionByName(long.select(*by, F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    wide = both.groupBy(*by, F.col("x").alias("column")).agg(
        *[F.max(F.when(F.col("y") == c, F.col("r"))).alias(c) for c in columns]
    )
    return wide.select(*by, "column", *[F.when(F.col("column") == c, F.lit(1.0)).otherwise(F.col(c)).alias(c) for c in columns])


def with_average_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add the average rank of ``column`` (1-based, equal values share the mean of their places), from positions in sorted slices.

    The table is sorted over all tasks; inside a slice the peers of a value give its first and last place, and a table with one row per slice joins
    the runs of equal values that cross slices. A value that a third of the rows hold lies in a third of the slices.
    """
    kept = rows.columns
    slices = range_slices(rows.withColumn("_tie", F.rand(7)), [column, "_tie"])  # equal values must not all go to one slice
    peers = Window.partitionBy("_slice").orderBy(column).rangeBetween(Window.currentRow, Window.currentRow)
    local = cut_lineage(slices.select(*kept, "_slice", F.min("_idx").over(peers).alias("_first"), F.max("_idx").over(peers).alias("_last")))
    ends = local.groupBy("_slice").agg(
        (F.max("_last") + 1).alias("n"), F.min_by(column, "_first").alias("low"), F.max_by(column, "_last").alias("high"),
        F.min("_last").alias("low_last"), F.max("_first").alias("high_first"),
    ).orderBy("_slice").collect()  # one row per slice
    before = np.concatenate([[0], np.cumsum([e["n"] for e in ends])])
    same = lambda a, b: a == b or (a != a and b != b)  # noqa: E731 - NaN is one value
    first, last = [0] * len(ends), [0] * len(ends)
    for i, e in enumerate(ends):  # where the run of the lowest value begins: here, or where the run that ends the slice before begins
        joins = i > 0 and same(ends[i - 1]["high"], e["low"])
        whole = joins and same(ends[i - 1]["low"], ends[i - 1]["high"])
        first[i] = (first[i - 1] if whole else int(before[i - 1]) + ends[i - 1]["high_first"]) if joins else int(before[i])
    for i in range(len(ends) - 1, -1, -1):
        e = ends[i]
        joins = i + 1 < len(ends) and same(ends[i + 1]["low"], e["high"])
        whole = joins and same(ends[i + 1]["low"], ends[i + 1]["high"])
        last[i] = (last[i + 1] if whole else int(before[i + 1]) + ends[i + 1]["low_last"]) if joins else int(before[i + 1]) - 1
    table = rows.sparkSession.createDataFrame([(e["_slice"], int(before[i]), e["n"], first[i], last[i]) for i, e in enumerate(ends)], "_slice int, _before long, _n long, _run_first long, _run_last long")
    joined = local.join(F.broadcast(table), "_slice")
    begin = F.when(F.col("_first") == 0, F.col("_run_first")).otherwise(F.col("_before") + F.col("_first"))
    end = F.when(F.col("_last") == F.col("_n") - 1, F.col("_run_last")).otherwise(F.col("_before") + F.col("_last"))
    return joined.select(*kept, ((begin + end) / 2.0 + 1.0).alias(name))


def rank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that know all ``columns``, with ``{col}_rank`` (average rank)."""
    rows = complete_rows(df, columns)
    for c in columns:
        rows = with_average_rank(rows, c, f"{c}_rank")
    return rows


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, n, r): rank correlation over complete rows."""
    ranked = rank_columns(df.select(*columns), columns)
    named = ranked.select(*[F.col(f"{c}_rank").alias(c) for c in columns])
    return pair_stats(named, columns).drop("cov")


def _discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted pairs with x_a < x_b and y_a > y_b. Rows sorted by (x, y); one pass per power of two."""
    order = np.lexsort((y, x))
    y, w = y[order], w[order].astype(float)
    pos = np.arange(len(y))
    total, size = 0.0, 1
    while size < len(y):
        block, right = pos // (2 * size), (pos // size) % 2
        idx = np.lexsort((right, y, block))  # equal y: left half first, so it is not counted as greater
        left_w = np.where(right[idx] == 0, w[idx], 0.0)
        run = np.cumsum(left_w)
        ends = np.bincount(block, weights=np.where(right == 0, w, 0.0))
        before = np.concatenate([[0.0], np.cumsum(ends)[:-1]])
        greater = before[block[idx]] + ends[block[idx]] - run
        total += float((greater * w[idx] * right[idx]).sum())
        size *= 2
    return total


def corr_kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, discordant, tau): Kendall tau-b, exact.

    Equal pairs are merged with weights and cut into slices along x and along y. Discordant pairs inside a slice are
    counted in its task; those that lie in different slices both ways follow from the slice-by-slice cell counts.
    """
    cells = complete_rows(df, [x, y]).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    sx = range_slices(cells, ["x", "y"]).withColumnRenamed("_slice", "sx").drop("_idx")
    both = range_slices(sx, ["y", "x"]).withColumnRenamed("_slice", "sy").drop("_idx")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [_discordant(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())]})

    in_x = both.groupBy("sx").applyInPandas(count, "d double").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("dx"))
    in_y = both.groupBy("sy").applyInPandas(count, "d double").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("dy"))
    in_both = both.groupBy("sx", "sy").applyInPandas(count, "d double").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("dxy"))
    # cells of the slice grid (slices x slices): weight with a smaller x slice and a greater y slice
    grid = both.groupBy("sx", "sy").agg(F.sum("w").alias("w"))
    rows = grid.groupBy("sx").agg(F.collect_list(F.struct("sy", "w")).alias("r"))
    wide = rows.agg(F.array_sort(F.collect_list(F.struct("sx", "r"))).alias("g"))

    @F.pandas_udf("double")
    def across(g: pd.Series) -> pd.Series:
        out = []
        for grid_rows in g:
            m = 1 + max(c["sy"] for r in grid_rows for c in r["r"])
            seen, total = np.zeros(m), 0.0
            for r in grid_rows:
                greater = np.concatenate([np.cumsum(seen[::-1])[::-1][1:], [0.0]])
                mine = np.zeros(m)
                for c in r["r"]:
                    mine[c["sy"]] += c["w"]
                total += float((mine * greater).sum())
                seen += mine
            out.append(total)
        return pd.Series(out)

    crossing = wide.select(across("g").alias("dc"))

    def ties(cols: list[str], name: str) -> DataFrame:
        g = both.groupBy(*cols).agg(F.sum("w").cast("double").alias("w"))
        return g.agg(F.coalesce(F.sum(F.col("w") * (F.col("w") - 1) / 2), F.lit(0.0)).alias(name), F.sum("w").alias(f"{name}_n"))

    one = zip_single_rows(in_x, in_y, in_both, crossing, ties(["x"], "n1"), ties(["y"], "n2"), ties(["x", "y"], "n12"))
    n = F.col("n1_n")
    n0 = n * (n - 1) / 2
    disc = F.col("dx") + F.col("dy") - F.col("dxy") + F.col("dc")
    conc = n0 - F.col("n1") - F.col("n2") + F.col("n12") - disc
    tau = F.try_divide(conc - disc, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
    return one.select(n.cast("long").alias("n"), disc.cast("long").alias("discordant"), tau.alias("tau"))


def strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a > 0.8, "very_strong").when(a > 0.7, "strong").when(a > 0.5, "moderate").otherwise("weak")


def strong_correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(x, y, r, strength), strongest first."""
    long = pair_stats(df, columns).where(F.abs("r") >= threshold)
    return long.select("x", "y", "r", strength(F.col("r")).alias("strength")).orderBy(F.desc(F.abs("r")), "x", "y")


def average_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, avg_abs_r)."""
    long = pair_stats(df, columns)
    ends = long.select(F.explode(F.array("x", "y")).alias("column"), "r")
    return ends.groupBy("column").agg((F.sum(F.coalesce(F.abs("r"), F.lit(0.0))) / (len(columns) - 1)).alias("avg_abs_r"))


def corr_clusters(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """(cluster, column): columns with |r| >= threshold to a seed; seeds are taken in column order. Clusters of one are left out."""
    pairs = [(r.x, r.y) for r in pair_stats(df, columns).where(F.abs("r") >= threshold).select("x", "y").collect()]  # p*p at most
    left, rows, number = list(columns), [], 0
    while left:
        seed = left.pop(0)
        group = [c for c in left if (seed, c) in pairs or (c, seed) in pairs]
        if group:
            rows += [(number, c) for c in (seed, *group)]
            left = [c for c in left if c not in group]
            number += 1
    return df.sparkSession.createDataFrame(rows, "cluster int, column string")


def nonlinear_candidates(
    df: DataFrame, columns: Sequence[str], gap: float = 0.3, least: float = 0.5
) -> DataFrame:
    """(x, y, pearson, spearman, difference) where |spearman| exceeds |pearson| by ``gap`` and ``least``."""
    cols = list(columns)
    lin = pair_stats(df, cols).select("x", "y", F.col("r").alias("pearson"))
    rank = corr_spearman(df, cols).select("x", "y", F.col("r").alias("spearman"))
    both = lin.join(rank, ["x", "y"]).withColumn("difference", F.abs("spearman") - F.abs("pearson"))
    return both.where((F.col("difference") > gap) & (F.abs("spearman") > least))


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by…, x, y, a, b, o): counts of value pairs of several column pairs in one job."""
    recs = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b"))
        for x, y in pairs
    ]
    long = df.select(*by, F.inline(F.array(*recs))).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return long.groupBy(*by, "x", "y", "a", "b").agg(F.count(F.lit(1)).alias("o"))


def chi2_stats(counts: DataFrame, keys: Sequence[str], correction: bool = True) -> DataFrame:
    """(keys…, n, rows, cols, chi2, g2, dof) from cell counts (keys…, a, b, o).

    The statistic is summed over the cells that occur: a cell with O = 0 adds E, and all E sum to n, so
    chi2 = sum over occurring cells of O²/E - n. 2×2 tables (Yates) are rebuilt from their margins.
    """
    keys = list(keys)
    ra = counts.groupBy(*keys, "a").agg(F.sum("o").alias("ra"))
    rb = counts.groupBy(*keys, "b").agg(F.sum("o").alias("rb"))
    size = ra.groupBy(*keys).agg(F.sum("ra").alias("n"), F.count(F.lit(1)).alias("rows"))
    width = rb.groupBy(*keys).agg(F.count(F.lit(1)).alias("cols"))
    full = counts.join(ra, [*keys, "a"]).join(rb, [*keys, "b"]).join(size, keys).join(width, keys)
    e = F.col("ra").cast("double") * F.col("rb") / F.col("n")
    o = F.col("o").cast("double")
    out = full.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("rows").alias("rows"), F.first("cols").alias("cols"),
        F.sum(o * o / e).alias("_s"), F.sum(2.0 * o * F.log(o / e)).alias("g2"),
        F.max(F.struct(o.alias("o"), e.alias("e"))).alias("_m"),
        # in a 2x2 table every cell is off by the same amount, and sum(1/E) = n³/(ra ra' rb rb')
        F.max(F.struct("ra", "rb")).alias("_c"),
    )
    off = F.abs(F.col("_m.o") - F.col("_m.e"))
    ra1, rb1, n = F.col("_c.ra").cast("double"), F.col("_c.rb").cast("double"), F.col("n").cast("double")
    yates = F.pow(off - F.least(F.lit(0.5), off), 2) * n * n * n / (ra1 * (n - ra1) * rb1 * (n - rb1))
    plain = F.greatest(F.col("_s") - n, F.lit(0.0))
    is22 = (F.col("rows") == 2) & (F.col("cols") == 2)
    chi2 = F.when(is22, yates).otherwise(plain) if correction else plain
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    return out.select(*keys, "n", "rows", "cols", chi2.alias("chi2"), F.greatest("g2", F.lit(0.0)).alias("g2"), dof.alias("dof"))


def chi2_independence(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by…, x, y, n, chi2, dof, p_value)."""
    st = chi2_stats(contingency(df, pairs, by), [*by, "x", "y"])
    return st.select(*by, "x", "y", "n", "chi2", "dof", chi2_p(F.col("chi2"), F.col("dof").cast("double")).alias("p_value"))


def cramers_v(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """(x, y, n, v, strength): bias-corrected Cramér's V of categorical columns."""
    st = chi2_stats(contingency(df, _pairs(columns)), ["x", "y"])
    n, r, k = F.col("n").cast("double"), F.col("rows").cast("double"), F.col("cols").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    st = st.withColumn("v", F.sqrt(F.try_divide(phi, F.least(kc - 1, rc - 1)))).where(F.col("v") >= threshold)
    label = F.when(F.col("v") > 0.8, "very_strong").when(F.col("v") > 0.6, "strong").when(F.col("v") > 0.3, "moderate").otherwise("weak")
    return st.select("x", "y", "n", "v", label.alias("strength"))


def anova_oneway(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(one row per test: groups, n, f, p_value, eta2; one row per group: count, mean, std)."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    per = rows.groupBy(*by, group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.var_pop(value).alias("_v")
    )
    tot = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("count").alias("n"), F.sum(F.col("count") * F.col("_v")).alias("ssw"),
        # between sum of squares from weighted moments of the group means
        F.sum(F.col("count") * F.col("mean")).alias("_sm"), F.sum(F.col("count") * F.col("mean") * F.col("mean")).alias("_sq"),
    )
    ssb = F.col("_sq") - F.col("_sm") * F.col("_sm") / F.col("n")
    tot = tot.withColumn("ssb", F.greatest(ssb, F.lit(0.0)))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    tot = tot.withColumn("f", F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2)))
    test = tot.select(
        *by, "groups", "n", "f", f_p(F.col("f"), d1.cast("double"), d2.cast("double")).alias("p_value"),
        F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta2"),
    )
    return test, per.drop("_v")


def linregress(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, slope, intercept, r2, std_err, covariance, p_value) of y on x."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    st = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.covar_samp(x, y).alias("covariance"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
    )
    df_ = (F.col("n") - 2).cast("double")
    se = F.when(df_ > 0, F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("_vy"), F.col("_vx") * df_)))
    st = st.withColumn("std_err", se)
    return st.select(
        *by, "n", "slope", "intercept", "r2", "std_err", "covariance",
        t_p(F.try_divide(F.col("slope"), F.col("std_err")), df_).alias("p_value"),
    )


def correlation_test(df: DataFrame, x: str, y: str, edge_exists: bool, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, r, t, p_value, significant, confirmed): does the correlation agree with the edge?"""
    st = pair_stats(df, [x, y], by)
    d = (F.col("n") - 2).cast("double")
    st = st.withColumn("t", F.col("r") * F.sqrt(F.try_divide(d, 1 - F.col("r") * F.col("r"))))
    st = st.withColumn("p_value", t_p(F.col("t"), d)).withColumn("significant", F.col("p_value") < alpha)
    return st.select(*by, "n", "r", "t", "p_value", "significant", (F.col("significant") == F.lit(edge_exists)).alias("confirmed"))


def point_biserial(df: DataFrame, value: str, group: str) -> DataFrame:
    """(n, high, r, p_value): correlation of a number with membership in the greater of two classes."""
    classes = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(3).collect()]
    if len(classes) != 2:
        raise ValueError(f"{group} must have two classes")
    coded = df.select(F.col(value).cast("double").alias("v"), (F.col(group) == F.lit(classes[1])).cast("double").alias("g"))
    out = correlation_test(coded, "g", "v", True)
    return out.select("n", F.lit(classes[1]).alias("high"), "r", "p_value")


def logistic_batch(df: DataFrame, pairs: Sequence[tuple[Column, Column]], rounds: int = 12, tol: float = 1e-7) -> list[dict]:
    """One-feature logistic models of many (0/1 label, number) pairs at once: Newton steps whose sums are one wide
    aggregation per round for all pairs. Returns n, coefficient, intercept, accuracy per pair."""
    rows = df.select(*[e for i, (y, x) in enumerate(pairs) for e in (y.cast("int").cast("double").alias(f"y{i}"), x.cast("double").alias(f"x{i}"))])
    ok = [F.col(f"y{i}").isNotNull() & F.col(f"x{i}").isNotNull() for i in range(len(pairs))]
    aggs = []
    for i in range(len(pairs)):
        x = F.when(ok[i], F.col(f"x{i}"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.avg(F.when(ok[i], F.col(f"y{i}"))).alias(f"p{i}")]
    st = rows.agg(*aggs).first()
    live = [i for i in range(len(pairs)) if st[f"n{i}"] and st[f"s{i}"] and 0.0 < st[f"p{i}"] < 1.0]
    fit = {i: np.array([math.log(st[f"p{i}"] / (1 - st[f"p{i}"])), 0.0]) for i in live}
    z = {i: (F.col(f"x{i}") - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"]) for i in live}
    todo = list(live)
    for _ in range(rounds):
        if not todo:
            break
        aggs = []
        for i in todo:
            a, b = fit[i]
            pr = 1.0 / (1.0 + F.exp(-(F.lit(float(a)) + F.lit(float(b)) * z[i])))
            w, g = pr * (1 - pr), F.col(f"y{i}") - pr
            for name, e in (("g0", g), ("g1", g * z[i]), ("h0", w), ("h1", w * z[i]), ("h2", w * z[i] * z[i])):
                aggs.append(F.sum(F.when(ok[i], e)).alias(f"{name}_{i}"))
        r = rows.agg(*aggs).first()
        rest = []
        for i in todo:
            h = np.array([[r[f"h0_{i}"], r[f"h1_{i}"]], [r[f"h1_{i}"], r[f"h2_{i}"]]])
            step = np.linalg.pinv(h) @ np.array([r[f"g0_{i}"], r[f"g1_{i}"]])
            fit[i] = fit[i] + np.clip(step, -5.0, 5.0)
            if np.abs(step).max() > tol and np.abs(fit[i]).max() < 50:
                rest.append(i)
        todo = rest
    acc = {}
    if live:
        right = [F.avg(F.when(ok[i], ((F.lit(float(fit[i][0])) + F.lit(float(fit[i][1])) * z[i] > 0).cast("double") == F.col(f"y{i}")).cast("double"))).alias(f"a{i}") for i in live]
        acc = rows.agg(*right).first().asDict()
    out = []
    for i in range(len(pairs)):
        if i in fit:
            b = float(fit[i][1]) / st[f"s{i}"]
            out.append({"n": st[f"n{i}"], "coefficient": b, "intercept": float(fit[i][0]) - b * st[f"m{i}"], "accuracy": acc[f"a{i}"]})
        else:
            out.append({"n": st[f"n{i}"], "coefficient": None, "intercept": None, "accuracy": 0.0})
    return out


def logistic_auc(df: DataFrame, value: str, flag: str) -> DataFrame:
    """(n, coefficient, intercept, auc) of a one-feature logistic model; ``flag`` is 0/1 or boolean."""
    rows = df.select(F.col(value).cast("double").alias("x"), F.col(flag).cast("int").cast("double").alias("label")).na.drop()
    model = logistic_batch(rows, [(F.col("label"), F.col("x"))])[0]
    # area under the curve from the counts per value: pairs ranked right, ties half
    counts = rows.groupBy("x").agg(F.sum("label").alias("p"), F.sum(1.0 - F.col("label")).alias("q"))
    run = with_running_sums(counts, ["x"], {"cq": F.col("q"), "cp": F.col("p")})
    area = F.sum(F.col("p") * (F.col("cq") - F.col("q") / 2))
    auc = run.agg(F.try_divide(area, F.max("cp_total") * F.max("cq_total")).alias("auc"), (F.max("cp_total") + F.max("cq_total")).cast("long").alias("n"))
    b = model["coefficient"] or 0.0
    up = F.col("auc") if b >= 0 else 1.0 - F.col("auc")
    return auc.select("n", F.lit(b).alias("coefficient"), F.lit(model["intercept"]).cast("double").alias("intercept"), up.alias("auc"))


def welch(n1: Column, m1: Column, v1: Column, n0: Column, m0: Column, v0: Column) -> tuple[Column, Column]:
    """t and Welch-Satterthwaite degrees of freedom."""
    a, b = v1 / n1, v0 / n0
    t = F.try_divide(m1 - m0, F.sqrt(a + b))
    d = F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n0 - 1))
    return t, d


def welch_t(df: DataFrame, value: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n1, n0, mean1, mean0, t, df, p_value, u, u_z, u_p): Welch t, and Mann-Whitney U with tie correction."""
    f = F.col(flag).cast("boolean")
    v = F.col(value).cast("double")
    st = df.where(F.col(flag).isNotNull()).groupBy(*by).agg(
        F.count(F.when(f, v)).cast("double").alias("n1"), F.count(F.when(~f, v)).cast("double").alias("n0"),
        F.avg(F.when(f, v)).alias("mean1"), F.avg(F.when(~f, v)).alias("mean0"),
        F.var_samp(F.when(f, v)).alias("v1"), F.var_samp(F.when(~f, v)).alias("v0"),
    )
    t, d = welch(F.col("n1"), F.col("mean1"), F.col("v1"), F.col("n0"), F.col("mean0"), F.col("v0"))
    st = st.withColumns({"t": t, "df": d})
    counts = df.where(F.col(flag).isNotNull() & v.isNotNull()).groupBy(*by, v.alias("_v")).agg(
        F.count(F.when(f, 1)).cast("double").alias("p"), F.count(F.when(~f, 1)).cast("double").alias("q")
    )
    run = with_running_sums(counts, ["_v"], {"cq": F.col("q")}, by)
    c = F.col("p") + F.col("q")
    u = run.groupBy(*by).agg(F.sum(F.col("p") * (F.col("cq") - F.col("q") / 2)).alias("u"), F.sum(c * c * c - c).alias("_ties"))
    both = st.join(u, list(by)) if by else zip_single_rows(st, u)
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    both = both.withColumn("u_z", F.try_divide(F.col("u") - n1 * n0 / 2, sd))
    return both.select(
        *by, n1.cast("long").alias("n1"), n0.cast("long").alias("n0"), "mean1", "mean0", "t", "df",
        t_p(F.col("t"), F.col("df")).alias("p_value"), "u", "u_z", norm_two_sided_p(F.col("u_z")).alias("u_p"),
    )


def flag_tests(df: DataFrame, flagged: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(flag, column, p_value): every column split by the null flag of every flagged column."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = [c for c in columns if c not in numeric]
    parts = []
    if numeric:
        rows = df.select(*[F.col(c).isNull().alias(f"_f{i}") for i, c in enumerate(flagged)], *[F.col(c).cast("double").alias(c) for c in numeric])
        aggs, recs = [], []
        for i, f in enumerate(flagged):
            for j, c in enumerate(numeric):
                if c == f:
                    continue
                for side, cond in (("1", F.col(f"_f{i}")), ("0", ~F.col(f"_f{i}"))):
                    x = F.when(cond, F.col(c))
                    aggs += [F.count(x).cast("double").alias(f"n{side}_{i}_{j}"), F.avg(x).alias(f"m{side}_{i}_{j}"), F.var_samp(x).alias(f"v{side}_{i}_{j}")]
                t, d = welch(*[F.col(f"{k}_{i}_{j}") for k in ("n1", "m1", "v1", "n0", "m0", "v0")])
                recs.append(F.struct(F.lit(f).alias("flag"), F.lit(c).alias("column"), t.alias("t"), d.alias("df")))
        if recs:
            long = rows.agg(*aggs).select(F.inline(F.array(*recs)))
            parts.append(long.select("flag", "column", t_p(F.col("t"), F.col("df")).alias("p_value")))
    if texts:
        coded = df.select(*texts, *[F.col(c).isNull().cast("string").alias(f"_f_{c}") for c in flagged])
        pairs = [(f"_f_{f}", c) for f in flagged for c in texts if c != f]
        if pairs:
            chi = chi2_independence(coded, pairs)
            parts.append(chi.select(F.substring("x", 4, 10000).alias("flag"), F.col("y").alias("column"), "p_value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ks_between(counts: DataFrame, keys: Sequence[str], value: str = "value", c1: str = "c1", c2: str = "c2") -> DataFrame:
    """(keys…, n1, n2, d, p_value) from counts of both samples per value."""
    run = with_running_sums(counts, [value], {"s1": F.col(c1), "s2": F.col(c2)}, keys)
    gap = F.abs(F.try_divide(F.col("s1"), F.col("s1_total")) - F.try_divide(F.col("s2"), F.col("s2_total")))
    st = run.groupBy(*keys).agg(F.max("s1_total").alias("n1"), F.max("s2_total").alias("n2"), F.max(gap).alias("d"))
    return st.withColumn("p_value", ks_p(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double")))


def ks_two_sample(df: DataFrame, value: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n1, n2, d, p_value): rows with ``flag`` against the others."""
    f = F.col(flag).cast("boolean")
    counts = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(
        F.count(F.when(f, 1)).alias("c1"), F.count(F.when(~f, 1)).alias("c2")
    )
    return ks_between(counts, by)


def vif(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, vif, level): diagonal of the inverse correlation matrix; nulls take the column mean."""
    cols = list(columns)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    filled = df.select(*by, *[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) for c in cols])

    def solve(n, m, cov):
        r = np.nan_to_num(correlation(cov), nan=0.0)
        np.fill_diagonal(r, 1.0)
        diag = np.diag(np.linalg.inv(r)) if np.linalg.matrix_rank(r) == len(cols) else np.full(len(cols), np.inf)
        return [{"column": c, "vif": float(v), "level": "extreme" if v > 10 else "high" if v > 5 else "ok"} for c, v in zip(cols, diag)]

    return from_moments(moment_rows(filled, cols, by), solve, "column string, vif double, level string", by)


def collinear_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Pairs with |r| above the threshold, for tables where the inflation factors cannot be solved."""
    return pair_stats(df, columns).where(F.abs("r") > threshold).select("x", "y", "r")


def partial_corr(
    df: DataFrame, x: str, y: str, controls: Sequence[str], edge_exists: bool = True, alpha: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """(by…, n, r, t, df, p_value, confirmed): correlation given the controls."""
    cols = [x, y, *controls]

    def solve(n, means, cov):
        r = partial_correlation(cov, 0, 1, range(2, len(cols)))
        d = n - 2 - len(controls)
        if math.isnan(r):  # a constant column: nothing is known
            return [{"n": int(n), "r": math.nan, "t": math.nan, "df": int(d), "p_value": math.nan}]
        t = r * math.sqrt(d / (1 - r * r)) if abs(r) < 1 and d > 0 else math.inf
        return [{"n": int(n), "r": r, "t": t, "df": int(d), "p_value": t_two_sided(t, d) if math.isfinite(t) else 0.0}]

    out = from_moments(moment_rows(df, cols, by), solve, "n long, r double, t double, df long, p_value double", by)
    out = out.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in ("r", "t", "p_value")})
    return out.withColumn("confirmed", (F.col("p_value") < alpha) == F.lit(edge_exists))


def _effect_row(fit: dict, n: float) -> dict:
    b, se, t, d = float(fit["coef"][1]), float(fit["se"][1]), float(fit["t"][1]), int(fit["df"])
    half = t_quantile(0.975, d) * se if d > 0 else math.nan
    k = len(fit["coef"]) - 1
    r2 = fit["r2"]
    return {
        "n": int(n), "coefficient": b, "std_err": se, "t": t, "p_value": t_two_sided(t, d), "ci_low": b - half, "ci_high": b + half,
        "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1) if d > 0 else math.nan,
    }


EFFECT_FIELDS = "n long, coefficient double, std_err double, t double, p_value double, ci_low double, ci_high double, r2 double, adj_r2 double"


def regression_test(
    df: DataFrame, cause: str, effect: str, controls: Sequence[str] = (), edge_exists: bool = True, alpha: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """OLS effect ~ cause + controls: coefficient of the cause, SE, t, p, interval, R²; ``confirmed`` when (p < alpha) agrees with the edge."""
    cols = [effect, cause, *controls]

    def solve(n, means, cov):
        return [_effect_row(ols(n, means, cov, 0, range(1, len(cols))), n)]

    out = from_moments(moment_rows(df, cols, by), solve, EFFECT_FIELDS, by)
    return out.withColumn("confirmed", (F.col("p_value") < alpha) == F.lit(edge_exists))


def backdoor_compare(
    df: DataFrame, treatment: str, outcome: str, adjustment_sets: Sequence[Sequence[str]], by: Sequence[str] = ()
) -> DataFrame:
    """The same regression without adjustment and for every adjustment set, all from one moment row."""
    cols = list(dict.fromkeys([outcome, treatment, *itertools.chain(*adjustment_sets)]))

    def solve(n, means, cov):
        out = []
        for s in [[], *adjustment_sets]:
            fit = ols(n, means, cov, 0, [1, *[cols.index(c) for c in s]])
            out.append({"adjustment": ",".join(s), **_effect_row(fit, n)})
        return out

    return from_moments(moment_rows(df, cols, by), solve, "adjustment string, " + EFFECT_FIELDS, by)


def multiple_testing(tests: DataFrame, p: str, key: Sequence[str], method: str = "bonferroni", alpha: float = 0.05) -> DataFrame:
    """Adds ``p_adjusted`` and ``significant``; method bonferroni, fdr (Benjamini-Hochberg) or none. ``key`` breaks ties."""
    if method == "none":
        out = tests.withColumn("p_adjusted", F.col(p))
    elif method == "bonferroni":
        n = tests.agg(F.count(p)).first()[0]
        out = tests.withColumn("p_adjusted", F.least(F.col(p) * F.lit(float(n)), F.lit(1.0)))
    elif method == "fdr":
        rows = with_position(tests.where(F.col(p).isNotNull()), [p, *key], length="_n")
        raw = rows.withColumn("_raw", F.col(p) * F.col("_n") / (F.col("_pos") + 1))
        out = with_suffix_min(raw, [p, *key], "_raw", "p_adjusted").withColumn("p_adjusted", F.least("p_adjusted", F.lit(1.0)))
        out = out.drop("_pos", "_n", "_raw")
    else:
        raise ValueError(f"unknown method: {method}")
    return out.withColumn("significant", F.col("p_adjusted") < alpha)


def random_feature_moments(
    df: DataFrame, groups: dict[str, Sequence[str]], features: int, kernel: str = "rbf", gamma: float | None = None, seed: int = 0
) -> tuple[DataFrame, dict[str, int]]:
    """Moments of random Fourier features of standardised column groups: one pass, nothing n×n.

    rbf exp(-gamma |d|²), laplacian exp(-gamma |d|_1); polynomial (gamma x·y + 1)³ is expanded exactly for one column.
    Returns the moment row and the number of features per group.
    """
    cols = list(dict.fromkeys(itertools.chain(*groups.values())))
    rows = complete_rows(df, cols)
    stats = _moments(rows, cols, F.avg, F.stddev_pop)
    centre = np.array([stats[c][0] or 0.0 for c in cols])
    width = np.array([stats[c][1] or 1.0 for c in cols])
    rng = np.random.default_rng(seed)
    parts, sizes = [], {}
    for g, members in groups.items():
        at = [cols.index(c) for c in members]
        gam = gamma if gamma is not None else 1.0 / len(at)
        if kernel == "polynomial" and len(at) == 1:
            parts.append((at, [math.sqrt(math.comb(3, i) * gam**i) for i in (1, 2, 3)], None))
            sizes[g] = 3
            continue
        shape = (len(at), features)
        w = gam * rng.standard_cauchy(shape) if kernel == "laplacian" else rng.normal(0.0, math.sqrt(2.0 * gam), shape)
        parts.append((at, w, rng.uniform(0.0, 2.0 * math.pi, features)))
        sizes[g] = features

    def expand(x: np.ndarray) -> np.ndarray:
        z = (x - centre) / width
        out = []
        for at, w, phase in parts:
            if phase is None:
                out.append(np.column_stack([c * z[:, at[0]] ** (i + 1) for i, c in enumerate(w)]))
            else:
                out.append(math.sqrt(2.0 / w.shape[1]) * np.cos(z[:, at] @ w + phase))
        return np.hstack(out)

    return feature_moments(rows, cols, expand, sum(sizes.values())), sizes


def gamma_null(n: float, stat: float, cx: np.ndarray, cy: np.ndarray) -> float:
    """Tail of n·HSIC under independence by the two-moment gamma approximation."""
    mean = float(np.trace(cx) * np.trace(cy))
    var = 2.0 * float((cx * cx).sum() * (cy * cy).sum())
    if mean <= 0 or var <= 0:
        return 1.0
    shape, scale = mean * mean / var, var / mean
    return gamma_q(shape, n * stat / scale)


def hsic_test(df: DataFrame, x: str, y: str, kernel: str = "rbf", alpha: float = 0.05, features: int = 40, seed: int = 0) -> DataFrame:
    """(n, hsic, p_value, independent): squared norm of the cross-covariance of random features."""
    moments, sizes = random_feature_moments(df, {"x": [x], "y": [y]}, features, kernel, seed=seed)
    a = sizes["x"]

    def solve(n, means, cov):
        stat = float((cov[:a, a:] ** 2).sum())
        p = gamma_null(n, stat, cov[:a, :a], cov[a:, a:])
        return [{"n": int(n), "hsic": stat, "p_value": p, "independent": p >= alpha}]

    return from_moments(moments, solve, "n long, hsic double, p_value double, independent boolean")


def residual_covariance(cov: np.ndarray, keep: Sequence[int], given: Sequence[int], ridge: float) -> np.ndarray:
    kk, kg, gg = cov[np.ix_(keep, keep)], cov[np.ix_(keep, given)], cov[np.ix_(given, given)]
    return kk - kg @ np.linalg.solve(gg + ridge * np.eye(len(given)), kg.T)


def cond_hsic_test(
    df: DataFrame, x: str, y: str, z: Sequence[str], kernel: str = "rbf", alpha: float = 0.05, features: int = 25, ridge: float = 1e-4, seed: int = 0
) -> DataFrame:
    """(n, hsic, p_value, independent): cross-covariance of the features of (x, z) and y that the features of z leave."""
    moments, sizes = random_feature_moments(df, {"x": [x, *z], "y": [y], "z": list(z)}, features, kernel, seed=seed)
    a, b = sizes["x"], sizes["y"]

    def solve(n, means, cov):
        left = list(range(a + b))
        res = residual_covariance(cov, left, list(range(a + b, len(cov))), ridge)
        stat = float((res[:a, a:] ** 2).sum())
        p = gamma_null(n, stat, res[:a, :a], res[a:, a:])
        return [{"n": int(n), "hsic": stat, "p_value": p, "independent": p >= alpha}]

    return from_moments(moments, solve, "n long, hsic double, p_value double, independent boolean")
