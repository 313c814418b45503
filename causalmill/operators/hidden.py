"""Signs of hidden common causes: correlations, tetrads and colliders against a graph over the columns."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import from_moments, moment_rows
from .graph import EDGE, G

FIELDS = [G, "method", "affects", "confidence", "detail"]


def _either_way(edges: DataFrame) -> DataFrame:
    """Undirected pairs (x < y) that an edge joins."""
    return edges.select(G, F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()


def _ordered(corr: DataFrame) -> DataFrame:
    return corr.select(G, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.abs("r").alias("r"))


def common_parents(edges: DataFrame) -> DataFrame:
    """(graph_id, parent, x, y) with x < y: pairs of children; the graph is over table columns, so a parent has few."""
    e = edges.select(*EDGE).distinct()
    a = e.select(G, F.col("src").alias("parent"), F.col("dst").alias("x"))
    b = e.select(G, F.col("src").alias("parent"), F.col("dst").alias("y"))
    return a.join(b, [G, "parent"]).where("x < y")


def hidden_by_correlation(edges: DataFrame, corr: DataFrame, threshold: float = 0.7, hidden_nodes: DataFrame | None = None) -> DataFrame:
    """Pairs without an edge whose |r| is above the threshold and that have no hidden parent; confidence (r - t) / (1 - t)."""
    found = _ordered(corr).where(F.col("r") > threshold).join(_either_way(edges), [G, "x", "y"], "left_anti")
    if hidden_nodes is not None:
        known = common_parents(edges).join(hidden_nodes.select(G, F.col("node").alias("parent")), [G, "parent"], "left_semi")
        found = found.join(known, [G, "x", "y"], "left_anti")
    return found.select(
        G, F.lit("correlation").alias("method"), F.array("x", "y").alias("affects"), ((F.col("r") - threshold) / (1 - threshold)).alias("confidence"),
        F.col("r").alias("detail"),
    )


def hidden_by_tetrad(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), share: float = 0.1) -> DataFrame:
    """Column quartets where exactly one of the three tetrad differences is below ``share`` of the mean |covariance|."""
    cols = sorted(columns)

    def solve(n, means, cov):
        s = cov * n / (n - 1)
        out = []
        for a, b, c, d in itertools.combinations(range(len(cols)), 4):
            ab_cd, ac_bd, ad_bc = s[a, b] * s[c, d], s[a, c] * s[b, d], s[a, d] * s[b, c]
            limit = share * float(np.abs(s[np.ix_([a, b, c, d], [a, b, c, d])]).mean())
            diffs = [abs(ac_bd - ad_bc), abs(ab_cd - ac_bd), abs(ab_cd - ad_bc)]
            small = [x < limit for x in diffs]
            if sum(small) == 1:
                out.append({"affects": [cols[i] for i in (a, b, c, d)], "confidence": 0.7, "detail": float(diffs[small.index(True)])})
        return out

    rows = from_moments(moment_rows(df, cols, by), solve, "affects array<string>, confidence double, detail double", by)
    return rows.withColumn("method", F.lit("tetrad"))


def hidden_by_collider(edges: DataFrame, corr: DataFrame, min_dependence: float = 0.3) -> DataFrame:
    """Parents of one node that no edge joins, with |r| above the limit and no common parent of their own."""
    e = edges.select(*EDGE).distinct()
    a = e.select(G, F.col("dst").alias("collider"), F.col("src").alias("x"))
    b = e.select(G, F.col("dst").alias("collider"), F.col("src").alias("y"))
    pairs = a.join(b, [G, "collider"]).where("x < y").join(_either_way(edges), [G, "x", "y"], "left_anti")
    pairs = pairs.join(common_parents(edges).select(G, "x", "y").distinct(), [G, "x", "y"], "left_anti")
    found = pairs.select(G, "x", "y").distinct().join(_ordered(corr).where(F.col("r") > min_dependence), [G, "x", "y"])
    return found.select(
        G, F.lit("collider").alias("method"), F.array("x", "y").alias("affects"),
        ((F.col("r") - min_dependence) / (1 - min_dependence)).alias("confidence"), F.col("r").alias("detail"),
    )


def hidden_merge(found: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(hidden variables, their edges): one per set of affected columns, the most confident (then by method name)."""
    every = found[0].select(*FIELDS)
    for f in found[1:]:
        every = every.unionByName(f.select(*FIELDS))
    every = every.withColumn("affects", F.array_sort("affects"))
    w = Window.partitionBy(G, "affects").orderBy(F.desc("confidence"), "method")
    best = every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    best = best.withColumn("name", F.concat(F.lit("Hidden_"), F.initcap("method"), F.lit("_"), F.array_join("affects", "_")))
    edges = best.select(G, F.col("name").alias("src"), F.explode("affects").alias("dst"), "confidence", F.lit(True).alias("is_hidden_cause"))
    return best, edges


def hidden_summary(hidden: DataFrame) -> DataFrame:
    return hidden.groupBy(G, "method").agg(F.count(F.lit(1)).alias("found"), F.avg("confidence").alias("avg_confidence"))
