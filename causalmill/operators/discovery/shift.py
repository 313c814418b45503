"""Changes over periods and domains: distributions, relations, and the graphs they suggest."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.lineage import cut_lineage
from ...functions.pvalues import chi2_p, f_p, ks_p
from ..association import pair_stats


def distribution_change(df: DataFrame, columns: Sequence[str], period: str, alpha: float = 0.05, min_rows: int = 5) -> DataFrame:
    """(column, pairs, max_d, p_value, changing): Kolmogorov-Smirnov over all pairs of periods with enough rows."""
    per = detail_ks(df, columns, period, min_rows)
    out = per.groupBy("column").agg(F.count(F.lit(1)).alias("pairs"), F.max("d").alias("max_d"), F.min("p_value").alias("p_value"))
    return out.withColumn("changing", F.col("p_value") < alpha)


GRID = 1000  # value intervals of a column, of about equally many rows
TOGETHER = 8  # periods whose counts are run side by side


def detail_ks(df: DataFrame, columns: Sequence[str], period: str, min_rows: int = 5) -> DataFrame:
    """(column, p1, p2, n1, n2, d, p_value) per pair of periods; periods are few.

    Marks from a sketch cut every column into intervals. Rows that equal a mark are only counted, so that frequent values are never shuffled; the others go
    to the task of their interval once, whatever the number of pairs, and are sorted there. The distances are exact: any marks give the same ones.
    """
    cols = list(columns)
    rows = df.where(F.col(period).isNotNull())
    every = cut_lineage(rows.select(period).distinct().withColumn("_t", F.row_number().over(Window.orderBy(period)) - 1))
    numbers = rows.join(F.broadcast(every), period).select("_t", *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)])
    shares = [k / GRID for k in range(GRID + 1)]
    marks = numbers.agg(*[F.percentile_approx(f"_x{i}", shares, 10 * GRID) for i in range(len(cols))]).first()
    splits = [[-math.inf, *(sorted({m for m in found or [] if math.isfinite(m)}) or [0.0]), math.inf] for found in marks]
    cut = Bucketizer(splitsArray=splits, inputCols=[f"_x{i}" for i in range(len(cols))], outputCols=[f"_g{i}" for i in range(len(cols))], handleInvalid="keep")
    recs = []
    for i in range(len(cols)):
        x, g = F.col(f"_x{i}"), F.col(f"_g{i}").cast("int")
        at = F.isnan(x) | F.coalesce(x == F.get(F.lit(np.array(splits[i])), g), F.lit(False))
        recs.append(F.struct(F.lit(i).alias("c"), g.alias("g"), at.alias("at"), x.alias("v")))
    long = cut.transform(numbers).select("_t", F.inline(F.array(*recs))).where("v is not null")
    n = every.count()
    blocks = [range(k, min(k + TOGETHER, n)) for k in range(0, n, TOGETHER)]
    found = [_block_ks(long, sorted({*a, *b}), [(p, q) for p in a for q in b if p < q]) for a, b in itertools.combinations_with_replacement(blocks, 2)]
    if not found:
        found = [_block_ks(long, [], [])]
    least = max(min_rows, 1)
    out = reduce(DataFrame.unionByName, found).where((F.col("n1") >= least) & (F.col("n2") >= least))
    for p, t in (("p1", "_p"), ("p2", "_q")):
        out = out.join(F.broadcast(every.select(F.col(period).alias(p), F.col("_t").alias(t))), t)
    return out.select(
        F.get(F.array(*[F.lit(c) for c in cols]), "c").alias("column"), "p1", "p2", "n1", "n2", "d",
        ks_p(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double")).alias("p_value"),
    )


def _block_ks(long: DataFrame, periods: Sequence[int], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(c, _p, _q, n1, n2, d): largest distance of the running shares, for the given pairs of ``periods``."""
    if not pairs:
        return long.select("c", F.lit(0).alias("_p"), F.lit(0).alias("_q"), F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), F.lit(0.0).alias("d")).limit(0)
    long = long.where(F.col("_t").isin(list(periods)))
    one = {t: F.when(F.col("_t") == t, 1).otherwise(0) for t in periods}
    # an interval starts at its mark, so the rows at the mark come before the others
    tally = long.groupBy("c", "g", "at").agg(*[F.sum(e).alias(f"n{t}") for t, e in one.items()])
    column = Window.partitionBy("c")
    upto = column.orderBy("g", F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    tally = cut_lineage(tally.select(
        "c", "g", "at", *[F.sum(f"n{t}").over(upto).alias(f"s{t}") for t in periods], *[(F.sum(f"n{t}").over(upto) - F.col(f"n{t}")).alias(f"o{t}") for t in periods],
        *[F.sum(f"n{t}").over(column).alias(f"t{t}") for t in periods],
    ))
    ends = tally.select("c", *[f"s{t}" for t in periods], *[f"t{t}" for t in periods])
    past = Window.partitionBy("c", "g").orderBy("v")  # up to the row and its equals
    inner = long.where("not at").select("c", "g", *[F.sum(e).over(past).alias(f"r{t}") for t, e in one.items()])
    inner = inner.join(F.broadcast(tally.where("not at").drop("at", *[f"s{t}" for t in periods])), ["c", "g"])
    inner = inner.select("c", *[(F.col(f"o{t}") + F.col(f"r{t}")).alias(f"s{t}") for t in periods], *[f"t{t}" for t in periods])
    share = {t: F.try_divide(f"s{t}", f"t{t}") for t in periods}
    best = ends.unionByName(inner).groupBy("c").agg(*[F.max(F.abs(share[p] - share[q])).alias(f"d{p}_{q}") for p, q in pairs], *[F.max(f"t{t}").alias(f"t{t}") for t in periods])
    rows = [F.struct(F.lit(p).alias("_p"), F.lit(q).alias("_q"), F.col(f"t{p}").alias("n1"), F.col(f"t{q}").alias("n2"), F.col(f"d{p}_{q}").alias("d")) for p, q in pairs]
    return best.select("c", F.inline(F.array(*rows)))


def relation_change(df: DataFrame, columns: Sequence[str], period: str, alpha: float = 0.05, min_rows: int = 10) -> DataFrame:
    """(x, y, periods, statistic, p_value, strength, changing): Fisher z of the correlation per period.

    statistic = sum of (n_t - 3)(z_t - mean z)² against chi-square with T - 1 degrees; strength = variance of the r_t.
    """
    per = pair_stats(df.where(F.col(period).isNotNull()), columns, [period]).where((F.col("n") >= min_rows) & F.col("r").isNotNull())
    z = F.atanh(F.greatest(F.least(F.col("r"), F.lit(1 - 1e-12)), F.lit(-1 + 1e-12)))
    w = (F.col("n") - 3).cast("double")
    st = per.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("periods"), F.sum(w * z * z).alias("_q"), F.sum(w * z).alias("_s"), F.sum(w).alias("_w"), F.var_pop("r").alias("strength")
    ).where("periods >= 2")
    st = st.withColumn("statistic", F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_w"), F.lit(0.0)))
    st = st.withColumn("p_value", chi2_p(F.col("statistic"), (F.col("periods") - 1).cast("double")))
    return st.select("x", "y", "periods", "statistic", "p_value", "strength", (F.col("p_value") < alpha).alias("changing"))


def nonstationary_graph(df: DataFrame, columns: Sequence[str], period: str, alpha: float = 0.05, top: int = 3, least: float = 0.3) -> DataFrame:
    """(src, dst, weight, evidence): where a relation changes, from the changing to the stable variable; changing variables
    also point to their ``top`` correlated columns unless the opposite edge is there."""
    dist = distribution_change(df, columns, period, alpha).select("column", "changing")
    rel = relation_change(df, columns, period, alpha)
    return combine_changes(dist, rel, pair_stats(df, columns), top, least)


def combine_changes(dist: DataFrame, rel: DataFrame, corr: DataFrame, top: int = 3, least: float = 0.3) -> DataFrame:
    dist = cut_lineage(dist)
    cx = dist.select(F.col("column").alias("x"), F.col("changing").alias("cx"))
    cy = dist.select(F.col("column").alias("y"), F.col("changing").alias("cy"))
    j = rel.where("changing").join(cx, "x").join(cy, "y").where("cx != cy")
    first = cut_lineage(j.select(
        F.when(F.col("cx"), F.col("x")).otherwise(F.col("y")).alias("src"), F.when(F.col("cx"), F.col("y")).otherwise(F.col("x")).alias("dst"),
        F.col("strength").alias("weight"), F.lit("relation").alias("evidence"),
    ))
    both = corr.select("x", "y", F.abs("r").alias("r")).unionByName(corr.select(F.col("y").alias("x"), F.col("x").alias("y"), F.abs("r").alias("r")))
    moving = both.join(dist.where("changing").select(F.col("column").alias("x")), "x", "left_semi")
    w = Window.partitionBy("x").orderBy(F.desc("r"), "y")  # the other columns
    near = moving.withColumn("k", F.row_number().over(w)).where((F.col("k") <= top) & (F.col("r") > least))
    near = near.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.col("r").alias("weight"), F.lit("correlation").alias("evidence"))
    near = near.join(first.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    # both columns may change: the edge from the smaller name is added first
    near = near.join(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src > dst"), ["src", "dst"], "left_anti")
    new = near.join(first.select("src", "dst"), ["src", "dst"], "left_anti")
    return first.unionByName(new.select(first.columns))


def domain_invariance(df: DataFrame, columns: Sequence[str], domain: str, alpha: float = 0.05) -> DataFrame:
    """(x, y, domains, n, f, p_value, slope_variance, mean_r2, invariant): Chow test of y on x over the domains.

    Both directions of a simple regression share R², so an invariant pair is reported without a direction.
    """
    cols = list(columns)
    pairs = list(itertools.combinations(cols, 2))
    recs = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")) for a, b in pairs]
    long = df.where(F.col(domain).isNotNull()).select(F.col(domain).alias("_d"), F.inline(F.array(*recs))).na.drop(subset=["_x", "_y"])
    per = cut_lineage(long.groupBy("x", "y", "_d").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_pop("_x").alias("vx"), F.var_pop("_y").alias("vy"), F.covar_pop("_x", "_y").alias("c"),
    ))
    n, g = F.col("n"), per
    slope = F.try_divide("c", "vx")
    # pooled moments from the moments of the domains
    tot = g.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("domains"), F.sum("n").alias("n"), (F.sum(n * F.col("mx")) / F.sum("n")).alias("gx"), (F.sum(n * F.col("my")) / F.sum("n")).alias("gy"),
        F.sum(n * (F.col("vy") - F.coalesce(F.try_divide(F.col("c") * F.col("c"), F.col("vx")), F.lit(0.0)))).alias("rss_s"),
        F.var_pop(slope).alias("slope_variance"), F.avg(F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))).alias("mean_r2"),
    )
    back = g.withColumnRenamed("n", "k").join(F.broadcast(tot.select("x", "y", "gx", "gy")), ["x", "y"]).groupBy("x", "y").agg(
        F.sum(F.col("k") * (F.col("vx") + F.pow(F.col("mx") - F.col("gx"), 2))).alias("sxx"),
        F.sum(F.col("k") * (F.col("vy") + F.pow(F.col("my") - F.col("gy"), 2))).alias("syy"),
        F.sum(F.col("k") * (F.col("c") + (F.col("mx") - F.col("gx")) * (F.col("my") - F.col("gy")))).alias("sxy"),
    )
    j = tot.join(back, ["x", "y"])
    rss_p = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    d1 = (F.col("domains") - 1) * 2.0
    d2 = F.col("n") - 2.0 * F.col("domains")
    j = j.withColumn("f", F.when(d2 > 0, F.try_divide((rss_p - F.col("rss_s")) / d1, F.col("rss_s") / d2)))
    j = j.withColumn("p_value", F.coalesce(f_p(F.greatest(F.col("f"), F.lit(0.0)), d1, d2), F.lit(1.0)))
    return j.select("x", "y", "domains", F.col("n").cast("long").alias("n"), "f", "p_value", "slope_variance", "mean_r2", ((F.col("p_value") > alpha) & (d2 > 0)).alias("invariant"))
