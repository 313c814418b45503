"""Causal order of linear non-Gaussian data (DirectLiNGAM) by passes of pairwise residual measures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.moments import complete_rows, moment_rows, ols
from ..graph import G

# fixed values: constants of the maximum-entropy approximation of differential entropy (Hyvarinen)
_K1, _K2, _GAMMA = 79.047, 7.4129, 0.37457


def _entropy(log_cosh: float, u_gauss: float) -> float:
    return (1 + math.log(2 * math.pi)) / 2 - _K1 * (log_cosh - _GAMMA) ** 2 - _K2 * u_gauss**2


def _measures(rows: DataFrame, cols: Sequence[str], weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(k, 2) means of log cosh u and u·exp(-u²/2) for k linear combinations u of the columns; one scan."""
    names = list(cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(weights), 2)), 0
        for pdf in batches:
            u = pdf[names].to_numpy(dtype=float) @ weights.T + offsets
            a = np.abs(u)
            total[:, 0] += (a + np.log1p(np.exp(-2 * a)) - math.log(2.0)).sum(axis=0)
            total[:, 1] += (u * np.exp(-u * u / 2)).sum(axis=0)
            n += len(pdf)
        yield pd.DataFrame({"k": np.arange(len(weights)), "a": total[:, 0], "b": total[:, 1], "n": n})

    sums = rows.mapInPandas(partial, "k long, a double, b double, n long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    out = np.zeros((len(weights), 2))
    for r in sums.collect():  # one row per combination of columns
        out[r.k] = (r.a / r.n, r.b / r.n)
    return out


def causal_order_lingam(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list, np.ndarray, np.ndarray]:
    """Exogenous variable first: at each step the column whose residuals look least like noise of the others is taken.

    Residual columns are linear combinations of the original ones, so each step is one scan of the table whatever its length.
    """
    cols = list(columns)
    p = len(cols)
    rows = complete_rows(df, cols)
    m = moment_rows(rows, cols).first()
    mean, cov = np.asarray(m["means"]), np.asarray(m["cov"]).reshape(p, p)
    combo = {i: np.eye(p)[i] for i in range(p)}  # current residual of column i as weights of the originals
    left, order = list(range(p)), []
    while len(left) > 1:
        specs, pos = [], {}

        def unit(v: np.ndarray) -> np.ndarray:
            s = math.sqrt(max(float(v @ cov @ v), 1e-300))
            return v / s

        for i in left:
            pos[(i, i)] = len(specs)
            specs.append(unit(combo[i]))
        for i in left:
            for j in left:
                if i != j:  # residual of i given j
                    xi, xj = unit(combo[i]), unit(combo[j])
                    pos[(i, j)] = len(specs)
                    specs.append(unit(xi - float(xi @ cov @ xj) * xj))
        w = np.array(specs)
        h = [_entropy(a, b) for a, b in _measures(rows, cols, w, -(w @ mean))]
        best = None
        for i in left:
            t = 0.0
            for j in left:
                if i != j:
                    diff = (h[pos[(j, j)]] + h[pos[(i, j)]]) - (h[pos[(i, i)]] + h[pos[(j, i)]])
                    t += min(0.0, diff) ** 2
            if best is None or t < best[0]:
                best = (t, i)
        root = best[1]
        order.append(root)
        left.remove(root)
        xr = unit(combo[root])
        for i in left:
            combo[i] = combo[i] - float(combo[i] @ cov @ xr) * xr
    order += left
    return [cols[i] for i in order], order, mean, cov


def direct_lingam(df: DataFrame, columns: Sequence[str], threshold: float = 0.05, graph_id: str = "all") -> DataFrame:
    """(graph_id, src, dst, weight): edges along the causal order, weights from regressions on the earlier columns.

    Edges whose standardised weight is at most ``threshold`` are left out.
    """
    cols = list(columns)
    _, order, mean, cov = causal_order_lingam(df, cols)
    out = []
    for k in range(1, len(order)):
        y, xs = order[k], order[:k]
        fit = ols(1e9, mean, cov, y, xs)
        for x, b in zip(xs, fit["coef"][1:]):
            if abs(b) * math.sqrt(cov[x, x] / max(cov[y, y], 1e-300)) > threshold:
                out.append((graph_id, cols[x], cols[y], float(b)))
    return df.sparkSession.createDataFrame(out, f"{G} string, src string, dst string, weight double")
