"""Sufficient statistics: one aggregation of means and covariances, then small solves on the stored rows.

Every linear method of the package (regression, partial correlation, VAR, effects) reads one *moment row* per group:
``n``, ``means`` (p numbers) and ``cov`` (p*p population covariances). Its size depends on the number of columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = 8  # above this many columns p*(p+1)/2 SQL aggregates outgrow one compiled method; numpy per batch is faster


def complete_rows(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(subset=list(cols))


def moment_rows(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, means, cov) over the rows where all ``cols`` are present; one scan, map-side combined."""
    rows = complete_rows(df, cols, by)
    if len(cols) > _WIDE:
        return _wide_moments(rows, cols, by)
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"_c{i}_{j}") for i in range(p) for j in range(i, p)]
    wide = rows.groupBy(*by).agg(*aggs)
    return wide.select(
        *by,
        "n",
        F.array(*[F.col(f"_m{i}") for i in range(p)]).alias("means"),
        F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("cov"),
    )


def _wide_moments(rows: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    shift = np.array([v or 0.0 for v in rows.agg(*[F.avg(c) for c in cols]).first()], dtype=float)
    return feature_moments(rows, cols, lambda x: x - shift, len(cols), by, shift)


def feature_moments(
    rows: DataFrame,
    cols: Sequence[str],
    features: Callable[[np.ndarray], np.ndarray],
    p: int,
    by: Sequence[str] = (),
    shift: np.ndarray | None = None,
) -> DataFrame:
    """Moment rows of ``p`` features that ``features`` computes from the columns of an Arrow batch.

    Each batch adds its cross products; they are summed per cell by a shuffle of p*(p+1) numbers per task, so the rows
    themselves never move. ``shift`` is added back to the means.
    """
    names, keys = list(cols), list(by)
    shift = np.zeros(p) if shift is None else shift
    schema = T.StructType(
        [rows.schema[c] for c in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, g in groups:
                x = features(g[names].to_numpy(dtype=float))
                body = np.vstack([x.sum(axis=0), x.T @ x])
                out = pd.DataFrame({"i": np.arange(-1, p, dtype=np.int32), "n": len(g), "v": list(body)})
                for k, val in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[k] = val
                yield out[[*keys, "i", "n", "v"]]

    cells = rows.mapInPandas(partial, schema).select(*keys, "i", "n", F.posexplode("v").alias("j", "v"))
    summed = cells.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    packed = summed.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("i", "j", "v")).alias("cells"))  # p*(p+1) cells

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            means, covs = [], []
            for n, cells in zip(pdf["n"], pdf["cells"]):
                m = np.zeros((p + 1, p))
                for c in cells:
                    m[c["i"] + 1, c["j"]] = c["v"]
                d = m[0] / n
                means.append(d + shift)
                covs.append((m[1:] / n - np.outer(d, d)).ravel())
            yield pdf[[*keys, "n"]].assign(means=means, cov=covs)

    done = T.StructType(
        [rows.schema[c] for c in keys]
        + [T.StructField("n", T.LongType()), T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType()))]
    )
    return packed.mapInPandas(finish, done)


def from_moments(
    moments: DataFrame,
    solve: Callable[[float, np.ndarray, np.ndarray], list[dict]],
    schema: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Run ``solve(n, means, cov)`` on every moment row; ``schema`` lists the fields of the dicts it returns."""
    keys = list(by)
    fields = T.StructType([moments.schema[c] for c in keys] + list(T._parse_datatype_string(schema).fields))
    names = [f.name for f in fields.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n, means = row["n"], np.asarray(row["means"], dtype=float)
                cov = np.asarray(row["cov"], dtype=float).reshape(len(means), len(means))
                for res in solve(float(n), means, cov):
                    out.append({**{k: row[k] for k in keys}, **res})
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype(object).where(frame.notna(), None)

    return moments.mapInPandas(run, fields)


def scaled_inverse(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a covariance matrix, taken of its correlations: columns of very different scale lose no digits."""
    s = np.sqrt(np.maximum(np.diag(m), 0.0))
    s = np.where(s > 0, s, 1.0)
    return np.linalg.pinv(m / np.outer(s, s), hermitian=True) / np.outer(s, s) if len(m) else np.zeros((0, 0))


def ols(n: float, means: np.ndarray, cov: np.ndarray, y: int, xs: Sequence[int]) -> dict:
    """Least squares with intercept from moments: coefficients (intercept first), SE, t, R2, residual sum of squares."""
    xs = list(xs)
    sxx = n * cov[np.ix_(xs, xs)]
    sxy = n * cov[xs, y]
    syy = n * cov[y, y]
    inv = scaled_inverse(sxx)
    beta = inv @ sxy
    rss = max(syy - float(beta @ sxy), 0.0)
    k = len(xs)
    df = n - k - 1
    s2 = rss / df if df > 0 else np.nan
    a = means[y] - float(beta @ means[xs])
    var_a = s2 * (1.0 / n + means[xs] @ inv @ means[xs])
    se = np.sqrt(np.maximum(np.concatenate([[var_a], s2 * np.diag(inv)]), 0.0))
    coef = np.concatenate([[a], beta])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
        r2 = 1.0 - rss / syy if syy > 0 else np.nan
    return {"coef": coef, "se": se, "t": t, "df": df, "rss": rss, "r2": r2, "tss": syy, "inv": inv, "s2": s2}


def partial_correlation(cov: np.ndarray, i: int, j: int, given: Sequence[int]) -> float:
    idx = [i, j, *given]
    prec = scaled_inverse(cov[np.ix_(idx, idx)])
    d = prec[0, 0] * prec[1, 1]
    return float(np.clip(-prec[0, 1] / np.sqrt(d), -1.0, 1.0)) if d > 0 else np.nan


def correlation(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(s, s)
