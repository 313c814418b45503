"""Constraint-based structure learning: batches of independence tests, PC skeleton, orientation.

Graphs are learned side by side: every table is keyed by ``graph_id``. The rows of the data are read once into sufficient
statistics (moments, or counts of the value combinations); the loops below run on tables whose size depends on the columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.cubes import counts_by_set, set_id
from ...functions.lineage import cut_lineage
from ...functions.moments import moment_rows, partial_correlation
from ...functions.pvalues import chi2_p
from ..association import chi2_stats, gamma_null, random_feature_moments, residual_covariance
from ..graph import EDGE, G

Tester = Callable[[DataFrame], DataFrame]  # (graph_id, x, y, given) -> the same with p_value
PAIR = [G, "x", "y"]


def with_graph(df: DataFrame, by: str | None) -> DataFrame:
    """Name the grouping column graph_id; one graph when there is none."""
    return df.withColumn(G, F.lit("all") if by is None else F.col(by).cast("string"))


def fisher_z(df: DataFrame, columns: Sequence[str], by: str | None = None) -> Tester:
    """Partial correlations from one moment row per graph (p² numbers beside each test)."""
    cols, p = list(columns), len(columns)
    moments = cut_lineage(moment_rows(with_graph(df, by), cols, [G]))

    @F.pandas_udf(T.DoubleType())
    def p_of(cov: pd.Series, n: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for c, rows, s in zip(cov, n, given):
            r = partial_correlation(np.asarray(c, dtype=float).reshape(s + 2, s + 2), 0, 1, list(range(2, s + 2)))
            free = rows - s - 3
            if not np.isfinite(r) or free <= 0:
                out.append(1.0)
                continue
            z = math.sqrt(free) * math.atanh(min(abs(r), 1 - 1e-12))
            out.append(math.erfc(z / math.sqrt(2.0)))
        return pd.Series(out, dtype="float64")

    def run(tests: DataFrame) -> DataFrame:
        rows = tests.join(F.broadcast(moments.select(G, "n", "cov")), G) if by is None else tests.join(moments.select(G, "n", "cov"), G)  # one row, or one per graph
        # only the numbers of the test's own columns go to Python
        at = F.transform(F.concat(F.array("x", "y"), "given"), lambda c: F.array_position(F.lit(cols), c).cast("int") - 1)
        own = F.flatten(F.transform(at, lambda i: F.transform(at, lambda j: F.get("cov", i * p + j))))
        rows = rows.select(*PAIR, "given", "n", F.size("given").alias("_k"), F.inline(F.array(F.struct(own.alias("_own")))))  # a row of its own keeps the numbers out of the Python call
        return rows.select(*PAIR, "given", p_of("_own", "n", "_k").alias("p_value"))

    return run


def count_test(df: DataFrame, columns: Sequence[str], by: str | None = None, statistic: str = "chi2") -> Tester:
    """Chi-square or G² within the strata of the conditioning values, from counts of the value combinations that occur.

    The combinations of all columns are counted once; from them one statement of grouping sets gives the counts of every column set that the tests ask for.
    """
    cols = list(columns)
    cube = with_graph(df, by).select(G, *[F.col(c).cast("string").alias(c) for c in cols]).na.drop().groupBy(G, *cols).agg(F.count(F.lit(1)).alias("_n"))
    cube = cut_lineage(cube)

    def run(tests: DataFrame) -> DataFrame:
        named = tests.withColumn("_set", set_id(F.concat("given", F.array("x", "y"))))
        cell = lambda c: F.element_at("_v", c)
        counts = named.join(counts_by_set(cube, [G], cols, named), [G, "_set"]).select(
            *PAIR, "given", F.transform("given", cell).alias("stratum"), cell(F.col("x")).alias("a"), cell(F.col("y")).alias("b"), "o"
        )
        per = chi2_stats(cut_lineage(counts), [*PAIR, "given", "stratum"], correction=False)
        total = per.groupBy(*PAIR, "given").agg(F.sum(statistic).alias("s"), F.sum("dof").alias("d"))
        p = F.when(F.col("d") > 0, chi2_p(F.col("s"), F.col("d").cast("double"))).otherwise(F.lit(1.0))
        return total.select(*PAIR, "given", p.alias("p_value"))

    return run


def kernel_test(df: DataFrame, columns: Sequence[str], features: int = 15, ridge: float = 1e-4, seed: int = 0) -> Tester:
    """Kernel independence from one pass of random features per column (the kernel of a set is the sum over its columns)."""
    cols = list(columns)
    moments, _ = random_feature_moments(df, {f"f{i}": [c] for i, c in enumerate(cols)}, features, seed=seed)
    row = moments.first()  # (columns * features)² numbers
    size = len(cols) * features
    shared = df.sparkSession.sparkContext.broadcast((float(row.n), np.asarray(row["cov"], dtype=float).reshape(size, size)))

    def p_of(x: pd.Series, y: pd.Series, given: pd.Series) -> pd.Series:
        n, cov = shared.value
        block = lambda c: list(range(cols.index(c) * features, (cols.index(c) + 1) * features))
        out = []
        for a, b, s in zip(x, y, given):
            keep = block(a) + block(b)
            z = [k for c in s for k in block(c)]
            res = residual_covariance(cov, keep, z, ridge) if z else cov[np.ix_(keep, keep)]
            stat = float((res[:features, features:] ** 2).sum())
            out.append(gamma_null(n, stat, res[:features, :features], res[features:, features:]))
        return pd.Series(out, dtype="float64")

    udf = F.pandas_udf(p_of, T.DoubleType())
    return lambda tests: tests.select(*PAIR, "given", udf("x", "y", "given").alias("p_value"))


def ci_test_batch(tester: Tester, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(graph_id, x, y, given, p_value, independent) for a table of tests."""
    return tester(tests).withColumn("independent", F.col("p_value") > alpha)


def all_pairs(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """(graph_id, x, y) with x < y for every graph of the data: p(p-1)/2 column pairs."""
    pairs = [tuple(sorted(t)) for t in itertools.combinations(columns, 2)]
    graphs = with_graph(df, by).select(G).distinct() if by else df.sparkSession.createDataFrame([("all",)], f"{G} string")
    return graphs.select(G, F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _subsets(items: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([[list(c) for c in itertools.combinations(sorted(v), int(n))] for v, n in zip(items, k)])


def pc_skeleton(
    tester: Tester, pairs: DataFrame, alpha: float = 0.05, max_given: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(skeleton graph_id, x, y; separating sets graph_id, x, y, given): the order-independent PC search.

    Level k tests every adjacent pair against all subsets of size k of the neighbours that either end has at the start of
    the level; pairs found independent leave together at its end.
    """
    adj = cut_lineage(pairs.select(*PAIR).distinct())
    sepsets, k = None, 0
    while max_given is None or k <= max_given:
        both = adj.unionByName(adj.select(G, F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.groupBy(G, "x").agg(F.array_sort(F.collect_set("y")).alias("near"))
        asked = both.join(near, [G, "x"]).withColumn("others", F.array_except("near", F.array("y"))).where(F.size("others") >= k)
        if k == 0:
            tests = adj.withColumn("given", F.array().cast("array<string>"))
        else:
            sets = asked.select(G, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.explode(_subsets("others", F.lit(k))).alias("given"))
            tests = sets.distinct()
        tests = cut_lineage(tests)
        if tests.isEmpty():
            break
        found = cut_lineage(tester(tests).where(F.col("p_value") > alpha).groupBy(*PAIR).agg(F.min("given").alias("given")))
        sepsets = found if sepsets is None else cut_lineage(sepsets.unionByName(found))
        adj = cut_lineage(adj.join(found, PAIR, "left_anti"))
        k += 1
    return adj, sepsets


def _both_ways(skeleton: DataFrame) -> DataFrame:
    return skeleton.select(G, F.col("x").alias("a"), F.col("y").alias("b")).unionByName(skeleton.select(G, F.col("y").alias("a"), F.col("x").alias("b")))


def _unshielded(adj: DataFrame) -> DataFrame:
    """(graph_id, a, c, b) with a < b: a–c–b where a and b are not adjacent."""
    left = adj.select(G, "a", F.col("b").alias("c"))
    right = adj.select(G, F.col("a").alias("b"), F.col("b").alias("c"))
    return left.join(right, [G, "c"]).where("a < b").join(adj.select(G, "a", "b"), [G, "a", "b"], "left_anti")


def colliders(adj: DataFrame, sepsets: DataFrame) -> DataFrame:
    """(graph_id, a, c, b): unshielded triples whose middle is not in the separating set of the ends."""
    seps = sepsets.select(G, F.col("x").alias("a"), F.col("y").alias("b"), "given")
    return _unshielded(adj).join(seps, [G, "a", "b"], "left").where(~F.coalesce(F.array_contains("given", F.col("c")), F.lit(False))).select(G, "a", "c", "b")


def orient_cpdag(skeleton: DataFrame, sepsets: DataFrame) -> DataFrame:
    """(graph_id, src, dst, mark_src, mark_dst): v-structures, then Meek's rules 1 to 3 until nothing changes.

    Undirected edges are kept once (src < dst) with two tails.
    """
    adj = cut_lineage(_both_ways(skeleton))
    v = colliders(adj, sepsets)
    arrows = v.select(G, F.col("a").alias("s"), F.col("c").alias("d")).unionByName(v.select(G, F.col("b").alias("s"), F.col("c").alias("d"))).distinct()
    arrows = cut_lineage(_one_way(arrows))
    near = adj.select(G, F.col("a").alias("s"), F.col("b").alias("d"))
    while True:
        fixed = arrows.unionByName(arrows.select(G, F.col("d").alias("s"), F.col("s").alias("d")))
        free = cut_lineage(near.join(fixed, [G, "s", "d"], "left_anti"))
        if free.isEmpty():
            break
        # 1: a -> b - c, a and c apart
        r1 = arrows.select(G, F.col("s").alias("a"), F.col("d").alias("s")).join(free, [G, "s"]).where("a != d")
        r1 = r1.join(near.select(G, F.col("s").alias("a"), "d"), [G, "a", "d"], "left_anti").select(G, "s", "d")
        # 2: a -> b -> c with a - c
        r2 = arrows.select(G, "s", F.col("d").alias("m")).join(arrows.select(G, F.col("s").alias("m"), "d"), [G, "m"]).select(G, "s", "d")
        r2 = r2.join(free, [G, "s", "d"], "left_semi")
        # 3: a - c -> b, a - e -> b, c and e apart, a - b
        half = free.select(G, "s", F.col("d").alias("m")).join(arrows.select(G, F.col("s").alias("m"), "d"), [G, "m"])
        two = half.join(half.withColumnRenamed("m", "m2"), [G, "s", "d"]).where("m < m2")
        r3 = two.join(near.select(G, F.col("s").alias("m"), F.col("d").alias("m2")), [G, "m", "m2"], "left_anti").join(free, [G, "s", "d"], "left_semi").select(G, "s", "d")
        new = cut_lineage(_one_way(r1.unionByName(r2).unionByName(r3).distinct()))
        if new.isEmpty():
            break
        arrows = cut_lineage(arrows.unionByName(new))
    done = arrows.select(G, F.col("s").alias("src"), F.col("d").alias("dst"), F.lit("tail").alias("mark_src"), F.lit("arrow").alias("mark_dst"))
    fixed = arrows.unionByName(arrows.select(G, F.col("d").alias("s"), F.col("s").alias("d")))
    rest = near.where("s < d").join(fixed, [G, "s", "d"], "left_anti")
    return done.unionByName(rest.select(G, F.col("s").alias("src"), F.col("d").alias("dst"), F.lit("tail").alias("mark_src"), F.lit("tail").alias("mark_dst")))


def _one_way(arrows: DataFrame) -> DataFrame:
    """Where both directions of an edge are claimed, keep the one from the smaller name."""
    pair = arrows.groupBy(G, F.least("s", "d").alias("lo"), F.greatest("s", "d").alias("hi")).agg(F.min("s").alias("s"))
    return pair.select(G, "s", F.when(F.col("s") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("d"))


def pag_orient(skeleton: DataFrame, sepsets: DataFrame) -> DataFrame:
    """(graph_id, src, dst, mark_src, mark_dst, bidirected): FCI marks by rules 0 to 3; ↔ stands for a hidden common cause.

    State: one row (a, b, mark) per edge end, the mark at ``b`` on the edge a–b.
    """
    adj = cut_lineage(_both_ways(skeleton))
    v = cut_lineage(colliders(adj, sepsets))
    heads = v.select(G, "a", F.col("c").alias("b")).unionByName(v.select(G, F.col("b").alias("a"), F.col("c").alias("b"))).distinct().withColumn("_h", F.lit("arrow"))
    marks = cut_lineage(adj.join(heads, [G, "a", "b"], "left").select(G, "a", "b", F.coalesce("_h", F.lit("circle")).alias("mark")))
    tri = cut_lineage(_unshielded(adj))
    chain = cut_lineage(tri.select(G, "a", "c", "b").unionByName(tri.select(G, F.col("b").alias("a"), "c", F.col("a").alias("b"))))
    while True:
        at = lambda a, b, m: marks.select(G, F.col("a").alias(a), F.col("b").alias(b), F.col("mark").alias(m))
        # 1: a *-> c o-* b, a and b apart: c -> b
        r1 = chain.join(at("a", "c", "m1"), [G, "a", "c"]).join(at("b", "c", "m2"), [G, "b", "c"]).where("m1 = 'arrow' AND m2 = 'circle'")
        new = r1.select(G, F.col("b").alias("a"), F.col("c").alias("b"), F.lit("tail").alias("new")).unionByName(
            r1.select(G, F.col("c").alias("a"), "b", F.lit("arrow").alias("new"))
        )
        # 2: a -> b *-> c or a *-> b -> c, and a *-o c: arrow at c
        two = at("a", "m", "am").join(at("m", "a", "ma"), [G, "a", "m"]).join(at("m", "c", "mc"), [G, "m"]).join(at("c", "m", "cm"), [G, "c", "m"])
        two = two.where("am = 'arrow' AND mc = 'arrow' AND (ma = 'tail' OR cm = 'tail') AND a != c")
        r2 = two.join(at("a", "c", "ac"), [G, "a", "c"]).where("ac = 'circle'").select(G, "a", F.col("c").alias("b"), F.lit("arrow").alias("new"))
        # 3: a *-> m <-* b, a *-o d o-* b, a and b apart, d *-o m: arrow at m on d–m
        ends = chain.where("a < b").withColumnRenamed("c", "m").join(at("a", "m", "x1"), [G, "a", "m"]).join(at("b", "m", "x2"), [G, "b", "m"]).where("x1 = 'arrow' AND x2 = 'arrow'")
        tops = ends.select(G, "a", "m", "b").join(at("a", "d", "y1"), [G, "a"]).join(at("b", "d", "y2"), [G, "b", "d"]).where("y1 = 'circle' AND y2 = 'circle' AND d != m")
        r3 = tops.join(at("d", "m", "dm"), [G, "d", "m"]).where("dm = 'circle'").select(G, F.col("d").alias("a"), F.col("m").alias("b"), F.lit("arrow").alias("new"))
        new = new.unionByName(r2).unionByName(r3).groupBy(G, "a", "b").agg(F.min("new").alias("new"))  # arrow before tail
        joined = cut_lineage(marks.join(new, [G, "a", "b"], "left"))
        if joined.where("mark = 'circle' AND new IS NOT NULL").isEmpty():
            break
        marks = cut_lineage(joined.select(G, "a", "b", F.when(F.col("mark") == "circle", F.coalesce("new", "mark")).otherwise(F.col("mark")).alias("mark")))
    pair = marks.where("a < b").select(G, F.col("a").alias("src"), F.col("b").alias("dst"), F.col("mark").alias("mark_dst")).join(
        marks.select(G, F.col("b").alias("src"), F.col("a").alias("dst"), F.col("mark").alias("mark_src")), EDGE
    )
    flip = (F.col("mark_src") == "arrow") & (F.col("mark_dst") != "arrow")
    return pair.select(
        G, F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(flip, F.col("mark_dst")).otherwise(F.col("mark_src")).alias("mark_src"), F.when(flip, F.col("mark_src")).otherwise(F.col("mark_dst")).alias("mark_dst"),
        ((F.col("mark_src") == "arrow") & (F.col("mark_dst") == "arrow")).alias("bidirected"),
    )


def pc(df: DataFrame, columns: Sequence[str], test: str = "fisherz", alpha: float = 0.05, by: str | None = None, max_given: int | None = None) -> DataFrame:
    """PC with fisherz, chi2, g2 or kernel tests."""
    skeleton, seps = pc_skeleton(make_tester(df, columns, test, by), all_pairs(df, columns, by), alpha, max_given)
    return orient_cpdag(skeleton, seps)


def fci(df: DataFrame, columns: Sequence[str], test: str = "fisherz", alpha: float = 0.05, by: str | None = None, max_given: int | None = None) -> DataFrame:
    skeleton, seps = pc_skeleton(make_tester(df, columns, test, by), all_pairs(df, columns, by), alpha, max_given)
    return pag_orient(skeleton, seps)


def make_tester(df: DataFrame, columns: Sequence[str], test: str, by: str | None = None) -> Tester:
    if test == "fisherz":
        return fisher_z(df, columns, by)
    if test in ("chi2", "g2"):
        return count_test(df, columns, by, test)
    if test == "kernel" and by is None:
        return kernel_test(df, columns)
    raise ValueError(f"unknown test: {test}")


def context_pc(df: DataFrame, columns: Sequence[str], context: str, alpha: float = 0.05, by: str | None = None, max_given: int | None = None) -> DataFrame:
    """PC with the domain or time index as one more variable; its edges point away from it."""
    cols = [*columns, context]
    numeric = df.withColumn(context, F.col(context).cast("double"))
    skeleton, seps = pc_skeleton(fisher_z(numeric, cols, by), all_pairs(numeric, cols, by), alpha, max_given)
    out = orient_cpdag(skeleton, seps)
    turned = (F.col("dst") == context) | ((F.col("src") == context) & (F.col("mark_dst") != "arrow"))
    flip = F.col("dst") == context
    return out.select(
        G, F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(turned, F.lit("tail")).otherwise(F.col("mark_src")).alias("mark_src"), F.when(turned, F.lit("arrow")).otherwise(F.col("mark_dst")).alias("mark_dst"),
    )
