"""Score-based structure learning: local scores from sufficient statistics and greedy search over edge changes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.cubes import counts_by_set, set_id
from ...functions.lineage import cut_lineage
from ...functions.moments import moment_rows
from ..graph import G
from .constraint import with_graph

Scorer = Callable[[DataFrame], DataFrame]  # (graph_id, node, parents array) -> the same with score
FAMILY = [G, "node", "parents"]


def _family(cols: Sequence[str], node: str, parents: Sequence[str]) -> list[int]:
    return [cols.index(node), *[cols.index(c) for c in parents]]


def bic_scorer(df: DataFrame, columns: Sequence[str], by: str | None = None, penalty: float = 1.0) -> Scorer:
    """-n/2 ln(residual variance) - k/2 ln n from one moment row per graph."""
    cols, p = list(columns), len(columns)
    moments = cut_lineage(moment_rows(with_graph(df, by), cols, [G]))

    @F.pandas_udf(T.DoubleType())
    def score_of(cov: pd.Series, n: pd.Series, node: pd.Series, parents: pd.Series) -> pd.Series:
        out = []
        for c, rows, y, xs in zip(cov, n, node, parents):
            at = _family(cols, y, xs)
            m = np.asarray(c, dtype=float).reshape(p, p)[np.ix_(at, at)]
            var = m[0, 0] - m[0, 1:] @ np.linalg.pinv(m[1:, 1:], hermitian=True) @ m[1:, 0] if len(at) > 1 else m[0, 0]
            out.append(-rows / 2.0 * math.log(max(float(var), 1e-12)) - penalty * len(at) / 2.0 * math.log(rows))
        return pd.Series(out, dtype="float64")

    def run(families: DataFrame) -> DataFrame:
        rows = families.join(F.broadcast(moments.select(G, "n", "cov")) if by is None else moments.select(G, "n", "cov"), G)  # one row, or one per graph
        return rows.select(*families.columns, score_of("cov", "n", "node", "parents").alias("score"))

    return run


def cv_scorer(df: DataFrame, columns: Sequence[str], key: Sequence[str], folds: int = 5, by: str | None = None) -> Scorer:
    """k-fold predictive log likelihood of linear models; moments per fold from one scan, the other folds by subtraction."""
    cols, p = list(columns), len(columns)
    fold = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(folds)).cast("int")
    keyed = with_graph(df, by).withColumn("_fold", fold)
    per = moment_rows(keyed, cols, [G, "_fold"]).select(G, F.struct("n", "means", "cov").alias("f"))
    per = cut_lineage(per.groupBy(G).agg(F.collect_list("f").alias("folds")))  # ``folds`` moment rows per graph

    @F.pandas_udf(T.DoubleType())
    def score_of(parts: pd.Series, node: pd.Series, parents: pd.Series) -> pd.Series:
        out = []
        for fs, y, xs in zip(parts, node, parents):
            at = _family(cols, y, xs)
            ns = np.array([float(f["n"]) for f in fs])
            ms = np.array([np.asarray(f["means"], dtype=float)[at] for f in fs])
            cs = np.array([np.asarray(f["cov"], dtype=float).reshape(p, p)[np.ix_(at, at)] for f in fs])
            raw = cs + ms[:, :, None] * ms[:, None, :]  # second moments about zero
            total = 0.0
            for k in range(len(fs)):
                rest = np.arange(len(fs)) != k
                n = ns[rest].sum()
                mean = (ns[rest, None] * ms[rest]).sum(axis=0) / n
                cov = (ns[rest, None, None] * raw[rest]).sum(axis=0) / n - np.outer(mean, mean)
                beta = np.linalg.pinv(cov[1:, 1:], hermitian=True) @ cov[1:, 0] if len(at) > 1 else np.zeros(0)
                w = np.concatenate([[1.0], -beta])
                var = max(float(w @ cov @ w), 1e-12)
                shift = float(w @ (ms[k] - mean))
                total -= ns[k] / 2.0 * (math.log(2 * math.pi * var) + (float(w @ cs[k] @ w) + shift * shift) / var)
            out.append(total)
        return pd.Series(out, dtype="float64")

    def run(families: DataFrame) -> DataFrame:
        return families.join(per, G).select(*families.columns, score_of("folds", "node", "parents").alias("score"))

    return run


def bdeu_scorer(df: DataFrame, columns: Sequence[str], by: str | None = None, prior: float = 1.0) -> Scorer:
    """BDeu for categorical columns, from counts of the value combinations that occur: one statement of grouping sets serves all families."""
    from ...functions.pvalues import lgamma_col

    cols = list(columns)
    text = with_graph(df, by).select(G, *[F.col(c).cast("string").alias(c) for c in cols]).na.drop()
    cube = cut_lineage(text.groupBy(G, *cols).agg(F.count(F.lit(1)).alias("_n")))
    levels = cut_lineage(cube.select(G, F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols]))).distinct().groupBy(G, "c").agg(F.count(F.lit(1)).alias("k")))

    def run(families: DataFrame) -> DataFrame:
        named = families.withColumn("_set", set_id(F.concat("parents", F.array("node"))))
        cells = named.join(counts_by_set(cube, [G], cols, named), [G, "_set"])
        fine = cells.select(*families.columns, F.transform("parents", lambda c: F.element_at("_v", c)).alias("_p"), F.col("o").cast("double").alias("nijk"))
        wide = named.select(*families.columns, F.explode(F.concat("parents", F.array("node"))).alias("c")).join(levels, [G, "c"])
        k = F.col("k").cast("double")
        wide = wide.groupBy(*families.columns).agg(F.coalesce(F.product(F.when(F.col("c") != F.col("node"), k)), F.lit(1.0)).alias("q"), F.max(F.when(F.col("c") == F.col("node"), k)).alias("r"))
        fine = fine.join(wide, families.columns).withColumn("ajk", F.lit(float(prior)) / (F.col("q") * F.col("r"))).withColumn("aj", F.lit(float(prior)) / F.col("q"))
        fine = fine.withColumn("_f", lgamma_col(F.col("nijk") + F.col("ajk")) - lgamma_col(F.col("ajk")))
        per = fine.groupBy(*families.columns, "_p").agg(F.sum("_f").alias("_f"), F.sum("nijk").alias("nij"), F.first("aj").alias("aj"))
        per = per.withColumn("_g", F.col("_f") + lgamma_col(F.col("aj")) - lgamma_col(F.col("nij") + F.col("aj")))
        return per.groupBy(*families.columns).agg(F.sum("_g").alias("score"))

    return run


def score_batch(scorer: Scorer, families: DataFrame) -> DataFrame:
    """(graph_id, node, parents, score)."""
    return scorer(families)


def greedy_search(scorer: Scorer, graphs: DataFrame, columns: Sequence[str], min_gain: float = 1e-6, max_rounds: int = 1000, scored_per_round: list | None = None) -> DataFrame:
    """(graph_id, src, dst): greedy adding, removing and turning of edges while the score grows, on DAGs.

    Each round makes a table of all allowed changes of all graphs and applies the best change per graph. Scores are kept by family (node and parent set):
    after the first round only the families around the node that changed are new and are scored; ``scored_per_round`` (if given) receives how many. The two directions of a first edge score alike, the one from the smaller name is taken. ``state`` has one row per graph with its edges (p² at most).
    """
    cols = list(columns)
    edge = "array<struct<s:string,d:string>>"
    state = cut_lineage(graphs.select(G).distinct().withColumn("e", F.array().cast(edge)))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in cols for b in cols if a != b])

    def parents(node):
        return F.array_sort(F.transform(F.filter("e", lambda x: x["d"] == node), lambda x: x["s"]))

    def has(a, b):
        return F.exists("e", lambda x: (x["s"] == a) & (x["d"] == b))

    @F.pandas_udf(T.BooleanType())
    def closes_cycle(e: pd.Series, a: pd.Series, b: pd.Series, turning: pd.Series) -> pd.Series:
        """Does the new edge a -> b (without b -> a when turning) close a cycle?"""
        out = []
        for edges, s, d, t in zip(e, a, b, turning):
            nxt: dict[str, list[str]] = {}
            for x in edges:
                if not (t and x["s"] == d and x["d"] == s):
                    nxt.setdefault(x["s"], []).append(x["d"])
            seen, todo = {d}, [d]
            while todo and s not in seen:
                for y in nxt.get(todo.pop(), []):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            out.append(s in seen)
        return pd.Series(out)

    cache: list[DataFrame] = []
    known = None
    for _ in range(max_rounds):
        moves = state.select(G, "e", F.inline(pairs))
        a, b = F.col("a"), F.col("b")
        kind = F.when(has(a, b), "remove").when(has(b, a), "turn").otherwise("add")
        moves = moves.withColumn("kind", kind).withColumn("pa", parents(a)).withColumn("pb", parents(b))
        moves = moves.where((F.col("kind") == "remove") | ~closes_cycle("e", "a", "b", F.col("kind") == "turn"))
        grown = F.array_sort(F.array_append("pb", a))
        less_b, less_a = F.array_remove("pb", a), F.array_remove("pa", b)
        # families before (weight -1) and after (weight +1) the change
        def fam(node, p, w):
            return F.struct(node.alias("node"), p.alias("parents"), F.lit(w).alias("w"))

        parts = F.when(F.col("kind") == "remove", F.array(fam(b, F.col("pb"), -1.0), fam(b, less_b, 1.0)))
        parts = parts.when(F.col("kind") == "add", F.array(fam(b, F.col("pb"), -1.0), fam(b, grown, 1.0)))
        parts = parts.otherwise(F.array(fam(b, F.col("pb"), -1.0), fam(b, grown, 1.0), fam(a, F.col("pa"), -1.0), fam(a, less_a, 1.0)))
        long = cut_lineage(moves.select(G, "a", "b", "kind", F.inline(parts)))
        new = long.select(*FAMILY).distinct()
        new = cut_lineage(new if known is None else new.join(known, FAMILY, "left_anti"))
        if scored_per_round is not None:
            scored_per_round.append(new.count())
        fresh = cut_lineage(scorer(new))
        cache.append(fresh)
        if len(cache) > 8:
            cache = [cut_lineage(reduce(DataFrame.unionByName, cache))]
        known = scored = reduce(DataFrame.unionByName, cache)
        gains = long.join(scored, FAMILY).groupBy(G, "a", "b", "kind").agg(F.sum(F.col("w") * F.col("score")).alias("gain"))
        best = gains.where(F.col("gain") > min_gain).groupBy(G).agg(F.min_by(F.struct("a", "b", "kind"), F.struct(-F.round("gain", 6), F.col("a") > F.col("b"), "kind", "a", "b")).alias("m"))
        best = cut_lineage(best)
        if best.isEmpty():
            break
        ma, mb, mk = F.col("m.a"), F.col("m.b"), F.col("m.kind")
        one = F.array(F.struct(ma.alias("s"), mb.alias("d"))).cast(edge)
        back = F.array(F.struct(mb.alias("s"), ma.alias("d"))).cast(edge)
        after = F.when(mk == "add", F.concat("e", one)).when(mk == "remove", F.array_except("e", one)).when(mk == "turn", F.concat(F.array_except("e", back), one)).otherwise(F.col("e"))
        state = cut_lineage(state.join(best, G, "left").select(G, after.alias("e")))
    return state.select(G, F.inline("e")).select(G, F.col("s").alias("src"), F.col("d").alias("dst"))
