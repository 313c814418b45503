"""Time-series discovery: VAR, Granger, instantaneous effects, VAR-LiNGAM, transfer entropy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.lineage import cut_lineage
from ...functions.moments import from_moments, moment_rows, ols
from ...functions.pvalues import f_upper
from ..graph import EDGE, G
from ..windows import lag_features
from .constraint import with_graph
from .lingam import direct_lingam


def default_lags(df: DataFrame) -> int:
    return max(min(10, df.count() // 5), 1)


def lagged_table(df: DataFrame, columns: Sequence[str], lags: int, order: Sequence[str], by: str | None = None) -> DataFrame:
    """graph_id, the columns and their lags ``{col}_lag{k}``, stored once for the passes that read it."""
    rows = with_graph(df, by).select(G, *order, *[F.col(c).cast("double").alias(c) for c in columns])
    return cut_lineage(lag_features(rows, columns, list(range(1, lags + 1)), order, [G]))


def _names(columns: Sequence[str], lags: int) -> list[str]:
    return [*columns, *[f"{c}_lag{k}" for k in range(1, lags + 1) for c in columns]]


def var_coefficients(lagged: DataFrame, columns: Sequence[str], lags: int) -> DataFrame:
    """(graph_id, target, source, lag, coef) of the vector autoregression; source null is the constant."""
    cols, p = list(columns), len(columns)

    def solve(n, means, cov):
        out = []
        xs = list(range(p, p + p * lags))
        for i, c in enumerate(cols):
            fit = ols(n, means, cov, i, xs)
            out.append({"target": c, "source": None, "lag": 0, "coef": float(fit["coef"][0])})
            for k in range(lags):
                for j, s in enumerate(cols):
                    out.append({"target": c, "source": s, "lag": k + 1, "coef": float(fit["coef"][1 + k * p + j])})
        return out

    return from_moments(moment_rows(lagged, _names(cols, lags), [G]), solve, "target string, source string, lag int, coef double", [G])


def var_fit(df: DataFrame, columns: Sequence[str], order: Sequence[str], lags: int | None = None, threshold: float = 0.1, by: str | None = None) -> DataFrame:
    """(graph_id, src, dst, time_lag, weight): edge where any lag has |coef| above the threshold; weight = sum of |coef|."""
    lags = lags or default_lags(df)
    coefs = var_coefficients(lagged_table(df, columns, lags, order, by), columns, lags)
    return var_edges(coefs, threshold)


def var_edges(coefs: DataFrame, threshold: float = 0.1) -> DataFrame:
    strong = F.when(F.abs("coef") > threshold, F.col("lag"))
    rows = coefs.where("source IS NOT NULL AND source != target")
    out = rows.groupBy(G, F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.min(strong).alias("time_lag"), F.sum(F.abs("coef")).alias("weight"))
    return out.where("time_lag IS NOT NULL")


def granger_tests(lagged: DataFrame, columns: Sequence[str], max_lag: int) -> DataFrame:
    """(graph_id, src, dst, lag, f, p_value): all ordered pairs; one moment row per graph and lag length."""
    cols, p = list(columns), len(columns)
    out = None
    for size in range(1, max_lag + 1):
        def solve(n, means, cov, size=size):
            rows = []
            for y in range(p):
                own = [p + k * p + y for k in range(size)]
                restricted = ols(n, means, cov, y, own)["rss"]
                for x in range(p):
                    if x == y:
                        continue
                    full = ols(n, means, cov, y, own + [p + k * p + x for k in range(size)])["rss"]
                    d2 = n - 2 * size - 1
                    f = ((restricted - full) / size) / (full / d2) if full > 0 and d2 > 0 else math.nan
                    rows.append({"src": cols[x], "dst": cols[y], "lag": size, "f": f, "p_value": f_upper(max(f, 0.0), size, d2) if math.isfinite(f) else None})
            return rows

        one = from_moments(moment_rows(lagged, _names(cols, size), [G]), solve, "src string, dst string, lag int, f double, p_value double", [G])
        out = one if out is None else out.unionByName(one)
    return out


def granger_pairwise(df: DataFrame, columns: Sequence[str], order: Sequence[str], max_lag: int = 5, alpha: float = 0.05, by: str | None = None) -> DataFrame:
    """(graph_id, src, dst, time_lag, p_value, weight): pairs whose least p over the lags is below alpha; weight 1 - p."""
    tests = granger_tests(lagged_table(df, columns, max_lag, order, by), columns, max_lag)
    best = tests.groupBy(*EDGE).agg(F.min("p_value").alias("p_value"), F.min_by("lag", F.struct("p_value", "lag")).alias("time_lag"))
    return best.where(F.col("p_value") < alpha).select(*EDGE, "time_lag", "p_value", (1 - F.col("p_value")).alias("weight"))


def _lasso(cov: np.ndarray, y: int, xs: Sequence[int], penalty: float) -> np.ndarray:
    """Coordinate descent on correlations: 1/2 |y - Xb|²/n + penalty |b|_1 for standardised columns."""
    s = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    r = cov / np.outer(s, s)
    a, c = r[np.ix_(xs, xs)], r[xs, y]
    b = np.zeros(len(xs))
    for _ in range(1000):
        old = b.copy()
        for k in range(len(xs)):
            rho = c[k] - a[k] @ b + a[k, k] * b[k]
            b[k] = math.copysign(max(abs(rho) - penalty, 0.0), rho)
        if np.abs(b - old).max() < 1e-10:
            break
    return b * s[y] / s[list(xs)]


def granger_lasso(df: DataFrame, columns: Sequence[str], order: Sequence[str], lags: int = 2, penalty: float = 0.01, by: str | None = None) -> DataFrame:
    """(graph_id, src, dst, time_lag, weight): non-zero lasso coefficients of all lagged columns, per target."""
    cols, p = list(columns), len(columns)

    def solve(n, means, cov):
        out = []
        for i, c in enumerate(cols):
            b = _lasso(cov, i, list(range(p, p + p * lags)), penalty)
            for j, s in enumerate(cols):
                mine = [(abs(b[k * p + j]), k + 1) for k in range(lags)]
                if s != c and max(mine)[0] > 0:
                    out.append({"src": s, "dst": c, "time_lag": max(mine)[1], "weight": float(sum(v for v, _ in mine))})
        return out

    lagged = lagged_table(df, cols, lags, order, by)
    return from_moments(moment_rows(lagged, _names(cols, lags), [G]), solve, "src string, dst string, time_lag int, weight double", [G])


def instantaneous_effects(df: DataFrame, columns: Sequence[str], order: Sequence[str], lags: int = 1, threshold: float = 0.3, by: str | None = None) -> DataFrame:
    """(graph_id, src, dst, weight, instantaneous): both directions of pairs whose VAR residuals correlate above the threshold."""
    cols, p = list(columns), len(columns)

    def solve(n, means, cov):
        xs = list(range(p, p + p * lags))
        res = cov[:p, :p] - cov[np.ix_(range(p), xs)] @ np.linalg.pinv(cov[np.ix_(xs, xs)], hermitian=True) @ cov[np.ix_(xs, range(p))]
        out = []
        for i in range(p):
            for j in range(p):
                d = math.sqrt(max(res[i, i] * res[j, j], 1e-300))
                if i != j and abs(res[i, j]) / d > threshold:
                    out.append({"src": cols[i], "dst": cols[j], "weight": float(abs(res[i, j]) / d), "instantaneous": True})
        return out

    lagged = lagged_table(df, cols, lags, order, by)
    return from_moments(moment_rows(lagged, _names(cols, lags), [G]), solve, "src string, dst string, weight double, instantaneous boolean", [G])


def combine_temporal(temporal: DataFrame, instantaneous: DataFrame) -> DataFrame:
    """(graph_id, src, dst, time_lag, weight, instantaneous): union of both edge tables with the greater weight."""
    a = temporal.select(*EDGE, "time_lag", F.col("weight").alias("_a"))
    b = instantaneous.select(*EDGE, F.col("weight").alias("_b"), F.lit(True).alias("instantaneous"))
    both = a.join(b, EDGE, "full_outer")
    return both.select(*EDGE, "time_lag", F.greatest("_a", "_b").alias("weight"), F.coalesce("instantaneous", F.lit(False)).alias("instantaneous"))


def var_lingam(df: DataFrame, columns: Sequence[str], order: Sequence[str], lags: int = 1, threshold: float = 0.1) -> DataFrame:
    """(graph_id, src, dst, src_lag, weight): LiNGAM on the VAR residuals for lag 0, and (I - B0)·M_k for the lags."""
    cols, p = list(columns), len(columns)
    lagged = lagged_table(df, cols, lags, order)
    coefs = {(r.target, r.source, r.lag): r.coef for r in var_coefficients(lagged, cols, lags).collect()}  # p² per lag
    rows = lagged.na.drop()
    residual = []
    for c in cols:
        fit = F.lit(coefs[(c, None, 0)])
        for k in range(1, lags + 1):
            for s in cols:
                fit = fit + F.lit(coefs[(c, s, k)]) * F.col(f"{s}_lag{k}")
        residual.append((F.col(c) - fit).alias(c))
    now = direct_lingam(cut_lineage(rows.select(*residual)), cols, 0.0).collect()
    b0 = np.zeros((p, p))
    for r in now:
        b0[cols.index(r.dst), cols.index(r.src)] = r.weight
    out = [("all", r.src, r.dst, 0, float(r.weight)) for r in now if abs(r.weight) > threshold]
    for k in range(1, lags + 1):
        m = np.array([[coefs[(c, s, k)] for s in cols] for c in cols])
        bk = (np.eye(p) - b0) @ m
        out += [("all", cols[j], cols[i], k, float(bk[i, j])) for i in range(p) for j in range(p) if abs(bk[i, j]) > threshold]
    return df.sparkSession.createDataFrame(out, f"{G} string, src string, dst string, src_lag int, weight double")


def transfer_entropy(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], max_lag: int = 2, bins: int = 10, least: float = 0.01, by: str | None = None, all_lags: bool = False
) -> DataFrame:
    """(graph_id, src, dst, time_lag, weight): greatest over the lags of H(T|T-) - H(T|T-,S-) in bits, kept above ``least``.

    Each lagged vector has its own equal-width bins. All pairs and lags are counted in one job.
    """
    cols = list(columns)
    lagged = lagged_table(df, cols, max_lag, order, by)
    ok = {k: F.col(f"{cols[0]}_lag{k}").isNotNull() for k in range(1, max_lag + 1)}
    aggs = []
    for k in range(1, max_lag + 1):
        for c in cols:
            for side, x in (("n", F.col(c)), ("l", F.col(f"{c}_lag{k}"))):
                aggs += [F.min(F.when(ok[k], x)).alias(f"lo_{side}_{c}_{k}"), F.max(F.when(ok[k], x)).alias(f"hi_{side}_{c}_{k}")]
    limits = lagged.groupBy(G).agg(*aggs)
    rows = lagged.join(limits, G)  # one row per graph on the right

    def code(side: str, c: str, k: int):
        x = F.col(c) if side == "n" else F.col(f"{c}_lag{k}")
        lo, hi = F.col(f"lo_{side}_{c}_{k}"), F.col(f"hi_{side}_{c}_{k}")
        return F.when(hi > lo, F.least(F.floor((x - lo) * bins / (hi - lo)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")

    recs = []
    for k in range(1, max_lag + 1):
        codes = F.array(*[
            F.struct(F.lit(s).alias("src"), F.lit(t).alias("dst"), F.lit(k).alias("lag"), code("l", s, k).alias("a"), code("n", t, k).alias("b"), code("l", t, k).alias("c"))
            for s in cols for t in cols if s != t
        ])
        recs.append(F.when(ok[k], codes))
    long = rows.select(G, F.explode(F.array(*recs)).alias("r")).where("r IS NOT NULL").select(G, F.inline("r"))
    cells = cut_lineage(long.groupBy(*EDGE, "lag", "a", "b", "c").agg(F.count(F.lit(1)).cast("double").alias("n")))
    keys = [*EDGE, "lag"]

    def minus_h(group: list[str], name: str) -> DataFrame:
        """sum of n·log2 n over the cells of the grouping"""
        g = cells.groupBy(*keys, *group).agg(F.sum("n").alias("n"))
        return g.groupBy(*keys).agg(F.sum(F.col("n") * F.log2("n")).alias(name), F.sum("n").alias("_n"))

    abc, ac = minus_h(["a", "b", "c"], "abc").drop("_n"), minus_h(["a", "c"], "ac").drop("_n")
    bc, c_ = minus_h(["b", "c"], "bc").drop("_n"), minus_h(["c"], "c_")
    j = c_.join(bc, keys).join(ac, keys).join(abc, keys)
    te = (F.col("c_") - F.col("bc") - F.col("ac") + F.col("abc")) / F.col("_n")
    per = j.select(*keys, F.greatest(te, F.lit(0.0)).alias("te"))
    if all_lags:
        return per
    best = per.groupBy(*EDGE).agg(F.max("te").alias("weight"), F.max_by("lag", F.struct(F.col("te"), -F.col("lag"))).alias("time_lag"))
    return best.where(F.col("weight") > least).select(*EDGE, "time_lag", "weight")
