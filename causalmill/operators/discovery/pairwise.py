"""Direction of a pair: additive noise and information-geometric tests, and a graph built from all pairs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.lineage import cut_lineage
from ...functions.moments import complete_rows, from_moments, moment_rows, ols
from ...functions.ordered import with_neighbours, with_position
from ...functions.quantiles import average_ranks
from ..association import _moments, gamma_null, hsic_test, random_feature_moments
from ..profile import _bin, _bounds


def _residual(df: DataFrame, x: str, y: str, degree: int) -> DataFrame:
    """(x, residual) of a polynomial regression of y on standardised x; coefficients from one moment row."""
    m, s = _moments(df, [x], F.avg, F.stddev_pop)[x]
    z = (F.col(x) - F.lit(m)) / F.lit(s if s else 1.0)
    rows = df.select(F.col(y).cast("double").alias("y"), *[F.pow(z, F.lit(k)).alias(f"z{k}") for k in range(1, degree + 1)])
    r = moment_rows(rows, rows.columns).first()
    p = degree + 1
    coef = ols(float(r.n), np.asarray(r["means"]), np.asarray(r["cov"]).reshape(p, p), 0, range(1, p))["coef"]
    fit = F.lit(float(coef[0]))
    for k in range(1, degree + 1):
        fit = fit + F.lit(float(coef[k])) * F.pow(z, F.lit(k))
    return df.select(F.col(x).cast("double").alias("x"), (F.col(y).cast("double") - fit).alias("r"))


def anm_direction(df: DataFrame, x: str, y: str, degree: int = 4, features: int = 40) -> DataFrame:
    """(x, y, score_forward, score_backward, direction, confidence): score = 1 - HSIC(cause, residual); the greater wins."""
    rows = complete_rows(df, [x, y])
    fwd = hsic_test(_residual(rows, x, y, degree), "x", "r", features=features).select(F.lit(1).alias("_k"), (1 - F.col("hsic")).alias("score_forward"))
    bwd = hsic_test(_residual(rows, y, x, degree), "x", "r", features=features).select(F.lit(1).alias("_k"), (1 - F.col("hsic")).alias("score_backward"))
    j = fwd.join(bwd, "_k")
    ahead = F.col("score_forward") > F.col("score_backward")
    return j.select(
        F.lit(x).alias("x"), F.lit(y).alias("y"), "score_forward", "score_backward", F.when(ahead, f"{x}->{y}").otherwise(f"{y}->{x}").alias("direction"),
        (F.greatest("score_forward", "score_backward") / (F.col("score_forward") + F.col("score_backward"))).alias("confidence"),
    )


def _igci_row(score: DataFrame, x: str, y: str) -> DataFrame:
    s = F.col("score")
    return score.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "score", F.when(s < 0, f"{x}->{y}").otherwise(f"{y}->{x}").alias("direction"), F.least(F.lit(1.0), F.abs(s)).alias("confidence"))


def _scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    b = _bounds(df, cols)
    eps = 1e-10
    return df.select(*[((F.col(c) - F.lit(b[c][0])) / F.lit(b[c][1] - b[c][0]) * (1 - 2 * eps) + eps).alias(c) for c in cols])


def igci_slope(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, score, direction, confidence): mean ln |Δy/Δx| along x on min-max scaled data; below 0 means x → y.

    Zero Δx takes the least positive Δx; steps with Δy = 0 have no logarithm and are left out.
    """
    rows = _scaled(complete_rows(df, [x, y]), [x, y])
    pos = with_position(rows, [x, y])
    near, w, own = with_neighbours(pos, 0, 1)
    d = near.select((F.lead(x).over(w) - F.col(x)).alias("dx"), (F.lead(y).over(w) - F.col(y)).alias("dy"), own.alias("_own")).where("_own AND dx IS NOT NULL")
    d = cut_lineage(d)
    least = d.where("dx > 0").agg(F.min("dx")).first()[0] or 1e-10
    dx = F.when(F.col("dx") == 0, F.lit(least)).otherwise(F.col("dx"))
    score = d.where("dy != 0").agg(F.avg(F.log(F.abs(F.col("dy") / dx))).alias("score"))
    return _igci_row(score, x, y)


def igci_entropy(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """(x, y, score, direction, confidence): difference of histogram entropies of the min-max scaled columns."""
    rows = complete_rows(df, [x, y])
    b = _bounds(rows, [x, y])
    recs = F.array(*[F.struct(F.lit(k).alias("k"), _bin(F.col(c), *b[c], bins).alias("bin")) for k, c in (("x", x), ("y", y))])
    counts = rows.select(F.inline(recs)).groupBy("k", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = counts.groupBy("k").agg(F.sum("n").alias("t"))
    d = F.col("n") / F.col("t") * bins
    h = counts.join(F.broadcast(total), "k").groupBy("k").agg((-F.sum(d * F.log(d))).alias("h"))
    score = h.agg((F.max(F.when(F.col("k") == "y", F.col("h"))) - F.max(F.when(F.col("k") == "x", F.col("h")))).alias("score"))
    return _igci_row(score, x, y)


def igci_entropy_knn(df: DataFrame, x: str, y: str, k: int = 10) -> DataFrame:
    """The same from mean ln distance to the k-th neighbour on rank / n; only ties make the two columns differ."""
    rows = complete_rows(df, [x, y])
    n = rows.count()
    k = min(k, n // 2)
    parts = []
    for side, c in (("x", x), ("y", y)):
        ranks = average_ranks(rows, [c]).select((F.col("rank") / n).alias("u"), "n")
        each = ranks.select("u", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        near, w, own = with_neighbours(with_position(each, ["u", "copy"]), k, k)
        options = [
            F.greatest(F.col("u") - (F.lag("u", a).over(w) if a else F.col("u")), (F.lead("u", k - a).over(w) if k - a else F.col("u")) - F.col("u")) for a in range(k + 1)
        ]
        # a window that leaves the series gives null on one side and is no candidate
        valid = [
            F.when((F.lag("u", a).over(w).isNotNull() if a else F.lit(True)) & (F.lead("u", k - a).over(w).isNotNull() if k - a else F.lit(True)), o)
            for a, o in enumerate(options)
        ]
        dist = near.select(F.least(*valid).alias("d"), own.alias("_own")).where("_own AND d > 0")
        parts.append(dist.agg(F.avg(F.log("d")).alias(f"h_{side}")).withColumn("_k", F.lit(1)))
    score = parts[0].join(parts[1], "_k").select((F.col("h_y") - F.col("h_x")).alias("score"))
    return _igci_row(score, x, y)


def pairwise_hsic(df: DataFrame, columns: Sequence[str], features: int = 20, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(x, y, n, hsic, p_value, dependent) of all column pairs from one pass."""
    cols = list(columns)
    moments, _ = random_feature_moments(df, {f"f{i}": [c] for i, c in enumerate(cols)}, features, seed=seed)

    def solve(n, means, cov):
        out = []
        block = lambda i: slice(i * features, (i + 1) * features)
        for i, j in itertools.combinations(range(len(cols)), 2):
            stat = float((cov[block(i), block(j)] ** 2).sum())
            p = gamma_null(n, stat, cov[block(i), block(i)], cov[block(j), block(j)])
            out.append({"x": cols[i], "y": cols[j], "n": int(n), "hsic": stat, "p_value": p, "dependent": p < alpha})
        return out

    return from_moments(moments, solve, "x string, y string, n long, hsic double, p_value double, dependent boolean")


def kernel_graph(df: DataFrame, columns: Sequence[str], alpha: float = 0.05, features: int = 20) -> DataFrame:
    """(src, dst, weight): dependent pairs directed by the additive noise test and added by weight unless they close a cycle."""
    cols = list(columns)
    rows = cut_lineage(complete_rows(df, cols))
    pairs = [(r.x, r.y) for r in pairwise_hsic(rows, cols, features, alpha).where("dependent").select("x", "y").collect()]
    found = []
    for x, y in pairs:  # pairs of columns
        r = anm_direction(rows, x, y, features=features).first()
        s, d = r.direction.split("->")
        found.append((r.confidence, s, d))
    nxt: dict[str, set[str]] = {}
    out = []
    for w, s, d in sorted(found, key=lambda t: (-t[0], t[1], t[2])):
        seen, todo = {d}, [d]
        while todo:
            for n in nxt.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        if s not in seen:
            nxt.setdefault(s, set()).add(d)
            out.append((s, d, float(w)))
    return df.sparkSession.createDataFrame(out, "src string, dst string, weight double")
