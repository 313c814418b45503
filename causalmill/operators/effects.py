"""Adjustment sets, treatment effects, sensitivity, path effects and counterfactuals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import join_checked
from ..functions.lineage import cut_lineage
from ..functions.moments import complete_rows, from_moments, moment_rows, ols
from ..functions.pvalues import t_p, t_quantile, t_two_sided
from .association import EFFECT_FIELDS, _effect_row, _moments
from .graph import EDGE, G, reach
from .missing import causal_order


# ---------------------------------------------------------------- adjustment sets

def _reach_avoiding(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, seed, avoid, node): nodes reached from ``seed`` without entering ``avoid``."""
    steps = cut_lineage(edges.select(G, F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    keys = [G, "seed", "avoid", "node"]
    delta = cut_lineage(starts.select(G, "seed", "avoid", F.col("seed").alias("node")).distinct())
    known = delta
    while not delta.isEmpty():
        found = delta.join(steps, [G, "node"]).where("next != avoid").select(G, "seed", "avoid", F.col("next").alias("node")).distinct()
        delta = cut_lineage(found.join(known, keys, "left_anti"))
        known = cut_lineage(known.unionByName(delta))
    return known


def adjustment_sets(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, treatment, outcome, kind, node) for the given pairs.

    backdoor: parents of the treatment. frontdoor: mediators without which the outcome cannot be reached. instrument:
    parents of the treatment that reach the outcome only through it and share no ancestor with it.
    """
    pairs = cut_lineage(pairs.select(G, "treatment", "outcome").distinct())
    edges = cut_lineage(edges.select(*EDGE).distinct())
    parents = pairs.join(edges.select(G, F.col("src").alias("node"), F.col("dst").alias("treatment")), [G, "treatment"])
    parents = cut_lineage(parents.where("node != outcome"))
    seeds = pairs.select(G, F.col("treatment").alias("node")).distinct()
    down = reach(edges, seeds).select(G, F.col("seed").alias("treatment"), "node")
    up_seeds = pairs.select(G, F.col("outcome").alias("node")).unionByName(parents.select(G, "node")).distinct()
    up = cut_lineage(reach(edges, up_seeds, backward=True))
    anc_y = up.select(G, F.col("seed").alias("outcome"), "node")
    between = pairs.join(down, [G, "treatment"]).join(anc_y, [G, "outcome", "node"]).where("node != outcome AND node != treatment")
    between = cut_lineage(between.select(G, "treatment", "outcome", "node"))
    free = _reach_avoiding(edges, between.select(G, F.col("treatment").alias("seed"), F.col("node").alias("avoid")))
    around = free.select(G, F.col("seed").alias("treatment"), F.col("avoid"), F.col("node").alias("outcome"))
    front = between.withColumnRenamed("node", "avoid").join(around, [G, "treatment", "outcome", "avoid"], "left_anti").withColumnRenamed("avoid", "node")
    other = _reach_avoiding(edges, parents.select(G, F.col("node").alias("seed"), F.col("treatment").alias("avoid")))
    direct = other.select(G, F.col("seed"), F.col("avoid").alias("treatment"), F.col("node").alias("outcome"))
    iv = parents.withColumnRenamed("node", "seed").join(direct, [G, "seed", "treatment", "outcome"], "left_anti")
    anc_z = up.select(G, "seed", F.col("node").alias("above"))
    shared = iv.join(anc_z, [G, "seed"]).join(anc_y.withColumnRenamed("node", "above"), [G, "outcome", "above"]).select(G, "treatment", "outcome", "seed").distinct()
    iv = iv.join(shared, [G, "treatment", "outcome", "seed"], "left_anti").withColumnRenamed("seed", "node")
    cols = [G, "treatment", "outcome"]
    out = parents.select(*cols, F.lit("backdoor").alias("kind"), "node")
    out = out.unionByName(front.select(*cols, F.lit("frontdoor").alias("kind"), "node"))
    return out.unionByName(iv.select(*cols, F.lit("instrument").alias("kind"), "node"))


# ---------------------------------------------------------------- effects

def _treated(df: DataFrame, treatment: str) -> Column:
    """True for the greater of the two treatment values."""
    if isinstance(df.schema[treatment].dataType, T.BooleanType):
        return F.col(treatment)
    values = [r[0] for r in df.select(treatment).where(F.col(treatment).isNotNull()).distinct().orderBy(treatment).limit(3).collect()]
    if len(values) != 2:
        raise ValueError(f"{treatment} must have two values")
    return F.col(treatment) == F.lit(values[1])


def ate_difference(df: DataFrame, treatment: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n1, n0, effect, std_err, t, p_value, ci_low, ci_high): difference of means, treated = the greater value."""
    t, y = _treated(df, treatment), F.col(outcome).cast("double")
    st = df.where(F.col(treatment).isNotNull()).groupBy(*by).agg(
        F.count(F.when(t, y)).alias("n1"), F.count(F.when(~t, y)).alias("n0"), F.avg(F.when(t, y)).alias("_m1"), F.avg(F.when(~t, y)).alias("_m0"),
        F.var_samp(F.when(t, y)).alias("_v1"), F.var_samp(F.when(~t, y)).alias("_v0"),
    )
    st = st.withColumns({"effect": F.col("_m1") - F.col("_m0"), "std_err": F.sqrt(F.col("_v1") / F.col("n1") + F.col("_v0") / F.col("n0"))})
    st = st.withColumn("t", F.try_divide("effect", "std_err"))
    return st.select(
        *by, "n1", "n0", "effect", "std_err", "t", t_p(F.col("t"), (F.col("n1") + F.col("n0") - 2).cast("double")).alias("p_value"),
        (F.col("effect") - 1.96 * F.col("std_err")).alias("ci_low"), (F.col("effect") + 1.96 * F.col("std_err")).alias("ci_high"),
    )


def design(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), max_levels: int = 200) -> tuple[DataFrame, list[str]]:
    """Numeric columns as they are and categories as 0/1 columns without their first level; returns the column names."""
    exprs, names = [], []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_levels + 1).collect())
            if len(levels) > max_levels:
                raise ValueError(f"{c} has more than {max_levels} levels")
            for v in levels[1:]:
                exprs.append((F.col(c) == F.lit(v)).cast("double").alias(f"{c}={v}"))
                names.append(f"{c}={v}")
        else:
            number = F.col(c).cast("int").cast("double") if isinstance(kind, T.BooleanType) else F.col(c).cast("double")
            exprs.append(number.alias(c))
            names.append(c)
    return df.select(*keep, *exprs), names


def _quote(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("=", "_").replace(" ", "_").replace(".", "_").replace("-", "_") for c in df.columns])


def ate_backdoor(df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """OLS outcome ~ treatment + covariates (categories as dummies): effect of the treatment with interval and R²."""
    wide, names = design(df, [outcome, treatment, *covariates], by)
    wide = _quote(wide)
    cols = wide.columns[len(by):]

    def solve(n, means, cov):
        return [_effect_row(ols(n, means, cov, 0, range(1, len(cols))), n)]

    return from_moments(moment_rows(wide, cols, by), solve, EFFECT_FIELDS, by).withColumnRenamed("coefficient", "effect")


def ate_frontdoor(df: DataFrame, treatment: str, mediator: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, a, b, effect, std_err, t, p_value): slope of the mediator on the treatment times its slope on the outcome."""
    def solve(n, means, cov):
        first, second = ols(n, means, cov, 1, [0]), ols(n, means, cov, 2, [0, 1])
        a, sa, b, sb = first["coef"][1], first["se"][1], second["coef"][2], second["se"][2]
        eff, se = a * b, math.sqrt(sa * sa * b * b + sb * sb * a * a)
        t = eff / se if se > 0 else math.nan
        return [{"n": int(n), "a": a, "b": b, "effect": eff, "std_err": se, "t": t, "p_value": t_two_sided(t, n - 3), "ci_low": eff - 1.96 * se, "ci_high": eff + 1.96 * se}]

    fields = "n long, a double, b double, effect double, std_err double, t double, p_value double, ci_low double, ci_high double"
    return from_moments(moment_rows(df, [treatment, mediator, outcome], by), solve, fields, by)


def ate_iv(df: DataFrame, treatment: str, instrument: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, effect, std_err, t, p_value, first_stage_f, strong): two-stage least squares with one instrument."""
    def solve(n, means, cov):
        first = ols(n, means, cov, 0, [1])
        slope = first["coef"][1]
        eff = cov[1, 2] / cov[1, 0] if cov[1, 0] else math.nan
        # second stage on the fitted treatment: variance slope² * var(instrument)
        sxx = n * slope * slope * cov[1, 1]
        rss = n * (cov[2, 2] - cov[1, 2] ** 2 / cov[1, 1])
        se = math.sqrt(rss / (n - 2) / sxx) if sxx > 0 else math.nan
        f = (first["r2"] / 1.0) / ((1 - first["r2"]) / (n - 2))
        t = eff / se
        return [{"n": int(n), "effect": eff, "std_err": se, "t": t, "p_value": t_two_sided(t, n - 2), "ci_low": eff - 1.96 * se, "ci_high": eff + 1.96 * se, "first_stage_f": f, "strong": f > 10}]

    fields = "n long, effect double, std_err double, t double, p_value double, ci_low double, ci_high double, first_stage_f double, strong boolean"
    return from_moments(moment_rows(df, [treatment, instrument, outcome], by), solve, fields, by)


_POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])  # P(X <= k), mean 1


def _uniform(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(rows, draws) uniforms from row keys by a 64-bit mixing function, the same wherever a row is processed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + (np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def bootstrap_draws(
    df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str], key: Sequence[str], draws: int = 500, seed: int = 42
) -> DataFrame:
    """(draw, effect): the regression effect under Poisson(1) row weights, all draws in one scan.

    Every Arrow batch adds its weighted cross products (draws × p² numbers); a row's weights come from its key, so a lost
    task is recomputed with the same weights.
    """
    wide, _ = design(df.withColumn("_key", F.xxhash64(*[F.col(c).cast("string") for c in key])), [outcome, treatment, *covariates], ["_key"])
    wide = _quote(wide).na.drop()
    cols = wide.columns[1:]
    centre = np.array([v[0] for v in _moments(wide, cols, F.avg).values()])
    p = len(cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws, (p + 1) * (p + 1)))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(dtype=float) - centre])
            w = np.searchsorted(_POISSON_CDF, _uniform(pdf["_key"].to_numpy(), draws, seed)).astype(float)
            total += w.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        yield pd.DataFrame({"draw": np.arange(draws, dtype=np.int32), "s": list(total)})

    cells = wide.mapInPandas(partial, "draw int, s array<double>").select("draw", F.posexplode("s").alias("k", "v"))
    packed = cells.groupBy("draw", "k").agg(F.sum("v").alias("v")).groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cells_ in pdf["c"]:
                m = np.array([c["v"] for c in cells_]).reshape(p + 1, p + 1)
                xs = [0, *range(2, p + 1)]
                out.append(float((np.linalg.pinv(m[np.ix_(xs, xs)], hermitian=True) @ m[xs, 1])[1]))
            yield pdf[["draw"]].assign(effect=out)

    return packed.mapInPandas(solve, "draw int, effect double")


def ate_bootstrap(
    df: DataFrame, treatment: str, outcome: str, covariates: Sequence[str] = (), *, key: Sequence[str], draws: int = 500, seed: int = 42
) -> DataFrame:
    """(draws, effect, std_err, ci_low, ci_high): percentile interval at positions int(0.025 B) and int(0.975 B).

    ``key`` identifies a row: equal rows must get their own weights.
    """
    d = bootstrap_draws(df, treatment, outcome, covariates, key, draws, seed)
    packed = d.agg(F.count("effect").alias("draws"), F.avg("effect").alias("effect"), F.stddev_pop("effect").alias("std_err"), F.array_sort(F.collect_list("effect")).alias("e"))
    at = lambda q: F.element_at("e", F.floor(F.col("draws") * q).cast("int") + 1)  # noqa: E731  ``draws`` numbers
    return packed.select("draws", "effect", "std_err", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def cate_interactions(
    df: DataFrame, treatment: str, outcome: str, modifiers: Sequence[str], covariates: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """(by…, term, effect, std_err, t, p_value, r2) of OLS with treatment × modifier terms; term ``main`` is the treatment."""
    rows = df.select(
        *by, F.col(outcome).cast("double").alias("_y"), F.col(treatment).cast("double").alias("_t"),
        *[F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(modifiers)],
        *[(F.col(treatment).cast("double") * F.col(m).cast("double")).alias(f"_x{i}") for i, m in enumerate(modifiers)],
        *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(covariates)],
    )
    cols = rows.columns[len(by):]

    def solve(n, means, cov):
        fit = ols(n, means, cov, 0, range(1, len(cols)))
        terms = [("main", 1)] + [(m, 2 + len(modifiers) + i) for i, m in enumerate(modifiers)]
        return [
            {"term": name, "effect": float(fit["coef"][k]), "std_err": float(fit["se"][k]), "t": float(fit["t"][k]), "p_value": t_two_sided(float(fit["t"][k]), fit["df"]), "r2": fit["r2"]}
            for name, k in terms
        ]

    return from_moments(moment_rows(rows, cols, by), solve, "term string, effect double, std_err double, t double, p_value double, r2 double", by)


def sensitivity_grid(effects: DataFrame, by: Sequence[str], effect: str = "effect", top: int = 30, step: int = 5) -> DataFrame:
    """(by…, r2_treatment, r2_outcome, adjusted_effect, bias, flips): effect·(1 - sqrt(r2_t·r2_y)) on a grid in percent
    steps without the origin; ``min_flip`` is the least product that changes the sign (null if none)."""
    steps = F.array(*[F.lit(v / 100.0) for v in range(0, top + 1, step)])
    grid = effects.select(*by, F.col(effect).alias("effect"), F.explode(steps).alias("r2_treatment")).select("*", F.explode(steps).alias("r2_outcome"))
    grid = grid.where("NOT (r2_treatment = 0 AND r2_outcome = 0)")
    adj = F.col("effect") * (1 - F.sqrt(F.col("r2_treatment") * F.col("r2_outcome")))
    grid = grid.withColumn("adjusted_effect", adj).withColumn("bias", F.col("adjusted_effect") - F.col("effect"))
    return grid.withColumn("flips", F.col("effect") * F.col("adjusted_effect") <= 0)


def sensitivity_robustness(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    product = F.col("r2_treatment") * F.col("r2_outcome")
    return grid.groupBy(*by).agg(F.first("effect").alias("effect"), F.min(F.when(F.col("flips"), product)).alias("min_flip"))


def path_effects(df: DataFrame, source: str, target: str, paths: Sequence[Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """(by…, path, total_effect, direct_effect, indirect_effect, path_effect): the indirect effect is split evenly."""
    mids = list(dict.fromkeys(n for p in paths for n in p[1:-1] if n in df.columns))
    cols = [target, source, *mids]
    indirect = [p for p in paths if len(p) > 2]

    def solve(n, means, cov):
        total = float(ols(n, means, cov, 0, [1])["coef"][1])
        direct = float(ols(n, means, cov, 0, range(1, len(cols)))["coef"][1]) if mids else total
        rest = total - direct
        return [
            {"path": ">".join(p), "total_effect": total, "direct_effect": direct, "indirect_effect": rest, "path_effect": direct if len(p) == 2 else rest / len(indirect)}
            for p in paths
        ]

    return from_moments(moment_rows(df, cols, by), solve, "path string, total_effect double, direct_effect double, indirect_effect double, path_effect double", by)


# ---------------------------------------------------------------- counterfactuals

def _affected(edges: Sequence[tuple[str, str]], source: str, target: str, columns: Sequence[str]) -> list[str]:
    """Nodes on a path from source to target, causes first, without the source."""
    def closure(start: str, pairs: Sequence[tuple[str, str]]) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for a, b in pairs:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        return seen

    on = closure(source, edges) & (closure(target, [(b, a) for a, b in edges]) | {target})
    if target not in on:
        raise ValueError(f"no path from {source} to {target}")
    return [c for c in causal_order(columns, edges) if c in on and c != source]


def fit_structure(df: DataFrame, edges: Sequence[tuple[str, str]], nodes: Sequence[str]) -> Mapping[str, tuple[list[str], object]]:
    """Model per node from its parents: linear equations for numbers (all from one scan), logistic for categories."""
    numeric = [c for c in dict.fromkeys([c for e in edges for c in e]) if isinstance(df.schema[c].dataType, T.NumericType)]
    models: dict[str, tuple[list[str], object]] = {}
    wanted = [c for c in nodes if c in numeric]
    parents = {c: [s for s, d in edges if d == c and s in numeric] for c in nodes}
    if wanted:
        def solve(n, means, cov):
            out = []
            for c in wanted:
                fit = ols(n, means, cov, numeric.index(c), [numeric.index(s) for s in parents[c]])
                out.append({"node": c, "coef": [float(v) for v in fit["coef"]]})
            return out

        for r in from_moments(moment_rows(df, numeric), solve, "node string, coef array<double>").collect():  # one row per column
            models[r.node] = (parents[r.node], list(r.coef))
    for c in nodes:
        if c not in models:
            known = df.select(c, *[F.col(s).cast("double").alias(s) for s in parents[c]]).na.drop()
            index = StringIndexer(inputCol=c, outputCol="_label").fit(known)
            vec = VectorAssembler(inputCols=parents[c], outputCol="_f")
            model = LogisticRegression(featuresCol="_f", labelCol="_label", predictionCol="_p", family="multinomial").fit(vec.transform(index.transform(known)))
            models[c] = (parents[c], (index.labels, model.coefficientMatrix.toArray(), model.interceptVector.toArray()))
    return models


def _predict(model: tuple[list[str], object], at: Mapping[str, Column]) -> Column:
    names, fit = model
    if isinstance(fit, list):
        value = F.lit(fit[0])
        for c, b in zip(names, fit[1:]):
            value = value + F.lit(b) * at[c]
        return value
    labels, coef, icept = fit
    scores = []
    for k, label in enumerate(labels):
        s = F.lit(float(icept[k]))
        for j, c in enumerate(names):
            s = s + F.lit(float(coef[k, j])) * at[c]
        scores.append(F.struct(s.alias("s"), F.lit(label).alias("v")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["v"]


def intervention_compare(
    df: DataFrame, edges: Sequence[tuple[str, str]], node: str, values: Sequence[float], outcome: str
) -> DataFrame:
    """One row per value: original and counterfactual mean of the outcome, effect, percent, interval, label, best.

    The equations are fitted once; every value is a projection of the same scan (no copies of the table).
    """
    cols = list(dict.fromkeys([c for e in edges for c in e] + [node, outcome]))
    chain = [] if node == outcome else _affected(edges, node, outcome, cols)
    models = fit_structure(df, edges, chain)
    rows = df.select(*cols).na.drop(subset=[outcome])
    aggs = [F.count(outcome).alias("n"), F.avg(outcome).alias("original_mean")]
    for i, v in enumerate(values):
        at: dict[str, Column] = {c: F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.col(c) for c in cols}
        at[node] = F.lit(float(v))
        for c in chain:
            at[c] = _predict(models[c], at)
        aggs += [F.avg(at[outcome]).alias(f"m{i}"), F.coalesce(F.stddev_samp(at[outcome]), F.lit(0.0)).alias(f"s{i}")]
    wide = rows.agg(*aggs)
    recs = [F.struct(F.lit(float(v)).alias("value"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, v in enumerate(values)]
    out = wide.select("n", "original_mean", F.inline(F.array(*recs)))
    effect = F.col("mean") - F.col("original_mean")
    percent = F.try_divide(effect, F.abs("original_mean")) * 100.0
    from ..functions.pvalues import t_quantile_col

    margin = t_quantile_col(F.lit(0.975), (F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt(F.col("n"))
    out = out.withColumns({"effect": effect, "percent": percent, "_margin": margin})
    label = F.when(F.abs("percent") < 5, "minimal").when(F.abs("percent") < 20, "moderate").otherwise("substantial")
    top = F.max(F.abs("effect")).over(_all_values())
    return out.select(
        "value", "n", "original_mean", "mean", "effect", "percent", (F.col("mean") - F.col("_margin")).alias("ci_low"),
        (F.col("mean") + F.col("_margin")).alias("ci_high"), label.alias("size"), (F.abs("effect") == top).alias("best"),
    )


def _all_values():
    from pyspark.sql import Window

    return Window.partitionBy("original_mean")  # one row per compared value


def counterfactual(df: DataFrame, edges: Sequence[tuple[str, str]], node: str, value: float, outcome: str) -> DataFrame:
    """What the outcome would be on average if ``node`` were ``value`` in every row."""
    return intervention_compare(df, edges, node, [value], outcome).drop("best")
