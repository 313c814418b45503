"""Missing values: profile, fill, model-based imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut_lineage
from ..functions.moments import correlation, ols
from ..functions.ordered import carried
from ..functions.quantiles import collect_quantiles, modes

MOMENT_COLUMNS = 8  # a regression on fewer numbers is solved from SQL moments, others by MLlib


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, percent, overall_percent), one scan."""
    cols = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"_m{i}") for i, c in enumerate(cols)])
    total = sum((F.col(f"_m{i}") for i in range(len(cols))), F.lit(0))
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"),
            F.try_divide(F.col(f"_m{i}") * F.lit(100.0), F.col("_rows")).alias("percent"),
            F.try_divide(total * F.lit(100.0), F.col("_rows") * len(cols)).alias("overall_percent"),
        )
        for i, c in enumerate(cols)
    ]
    return counts.select(F.inline(F.array(*rows))).orderBy(F.desc("missing"), "column")


def dropna(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def impute_mean_median(df: DataFrame, columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Fill numeric nulls with the mean or the exact median."""
    if method == "median":
        fills = {c: q[0] for c, q in collect_quantiles(df, columns, [0.5]).items()}
    else:
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        fills = {c: row[c] for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items() if v is not None})


def impute_mode_constant(df: DataFrame, columns: Sequence[str], value=None) -> DataFrame:
    """Fill nulls with ``value``, or with the most frequent value (the smallest on ties)."""
    if value is not None:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})
    fills = {}
    for kind, cols in (("double", [c for c in columns if _is_numeric(df, c)]), ("string", [c for c in columns if not _is_numeric(df, c)])):
        if cols:
            fills.update({r["column"]: r["value"] for r in modes(df, cols, as_type=kind).collect()})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items()})


def fill_forward_backward(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (), method: str = "ffill"
) -> DataFrame:
    """Last known value before the row (ffill) or next known value after it (bfill), series kept over all tasks."""
    exprs = {f"_f_{c}": F.col(c) for c in columns}
    out = carried(df, order, forward=exprs if method == "ffill" else None, backward=exprs if method == "bfill" else None, by=by)
    keep = [F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return out.select(*keep)


def interpolate_time(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Linear in time (``order[0]``) between known points; the tail repeats the last value, leading nulls stay."""
    def known(c: str):
        return F.when(F.col(c).isNotNull(), F.struct(_seconds(df, order[0]).alias("t"), F.col(c).cast("double").alias("v")))

    out = carried(
        df, order, forward={f"_p_{c}": known(c) for c in columns}, backward={f"_n_{c}": known(c) for c in columns}, by=by
    )
    picked = []
    for c in df.columns:
        if c not in columns:
            picked.append(F.col(c))
            continue
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        share = F.try_divide(_seconds(df, order[0]) - p["t"], n["t"] - p["t"])
        line = p["v"] + F.coalesce(share, F.lit(0.0)) * (n["v"] - p["v"])
        picked.append(F.coalesce(F.col(c).cast("double"), line, p["v"]).alias(c))
    return out.select(*picked)


def _seconds(df: DataFrame, c: str):
    kind = df.schema[c].dataType
    if isinstance(kind, T.NumericType):
        return F.col(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double") * 86400.0
    return F.unix_micros(F.col(c).cast("timestamp")).cast("double") / 1e6


def impute_knn(
    df: DataFrame, columns: Sequence[str], key: str, k: int = 5, donors_max: int = 2_000, counts: dict | None = None
) -> DataFrame:
    """Mean of the ``k`` nearest rows (distance over the columns both rows know, scaled up for missing ones).

    Equal rows are merged with their count. Donors and incomplete combinations are cut into blocks of at most ``donors_max`` by their distances to pivots;
    only blocks that the triangle bound cannot shut out are compared, so the work follows the rows that are near.
    """
    from .neighbours import nan_euclidean_fill

    return nan_euclidean_fill(df, columns, key, k, donors_max, counts)


def missingness_type(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(column, tests, significant, mar_share, kind) with kind NONE, MCAR, MAR or MNAR.

    Every other column is split by the null flag of ``column``: Welch t for numbers, chi-square for categories. Under
    10 % significant → MCAR. Otherwise a one-feature logistic model of the flag is fitted per column; accuracy above 0.6
    in more than 30 % of them → MAR, else MNAR.
    """
    from .association import flag_tests, logistic_batch

    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    flagged = [c for c in columns if counts[c]]
    spark = df.sparkSession
    none = [(c, 0, 0, None, "NONE") for c in columns if not counts[c]]
    rows = spark.createDataFrame(none, "column string, tests long, significant long, mar_share double, kind string")
    if not flagged:
        return rows
    tests = cut_lineage(flag_tests(df, flagged, columns))
    stats = {
        r["flag"]: r
        for r in tests.groupBy("flag").agg(
            F.count("p_value").alias("tests"), F.count(F.when(F.col("p_value") < alpha, 1)).alias("significant")
        ).collect()
    }
    def tested(c: str) -> tuple[int, int]:
        return (stats[c].tests, stats[c].significant) if c in stats else (0, 0)

    open_cols = [c for c in flagged if tested(c)[0] and tested(c)[1] / tested(c)[0] >= 0.1]
    asked = [(c, x) for c in open_cols for x in columns if x != c and _is_numeric(df, x)]
    fits = logistic_batch(df, [(F.col(c).isNull(), F.col(x)) for c, x in asked]) if asked else []
    out = []
    for c in flagged:
        hits = [m["accuracy"] > 0.6 for (f, _), m in zip(asked, fits) if f == c]
        share = sum(hits) / len(hits) if hits else (0.0 if c in open_cols else None)
        kind = "MCAR" if c not in open_cols else "MAR" if share > 0.3 else "MNAR"
        out.append((c, *tested(c), share, kind))
    return rows.unionByName(spark.createDataFrame(out, rows.schema))


def _with_numbers(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """``df`` and ``_m_<c>``: the numeric predictors, with their mean where they are missing."""
    if not numeric:
        return df
    base = df.withColumns({f"_n_{c}": F.col(c).cast("double") for c in numeric})
    return Imputer(inputCols=[f"_n_{c}" for c in numeric], outputCols=[f"_m_{c}" for c in numeric]).fit(base).transform(base)


def _with_features(df: DataFrame, numeric: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """``_features`` for mixed predictors: numbers as they are, categories one-hot.

    ``VectorAssembler`` is not deterministic to Spark, so passes that do not ask for its vectors make them too; plain numbers go without it.
    """
    if not texts:
        return df.withColumn("_features", array_to_vector(F.array(*[F.col(f"_m_{c}") for c in numeric])))
    index = StringIndexer(inputCols=list(texts), outputCols=[f"_i_{c}" for c in texts], handleInvalid="keep")
    onehot = OneHotEncoder(inputCols=[f"_i_{c}" for c in texts], outputCols=[f"_o_{c}" for c in texts])
    for s in (index, onehot):
        df = s.fit(df).transform(df)
    return VectorAssembler(inputCols=[f"_m_{c}" for c in numeric] + [f"_o_{c}" for c in texts], outputCol="_features").transform(df)


def _line(known: DataFrame, y: str, xs: Sequence[str]) -> Column | None:
    """Least squares of ``y`` on a few columns ``xs``, as a column: one scan of moments, no row becomes a vector.

    None where moments do not do: values that are not finite, or columns that hang together.
    """
    cols = [y, *xs]
    p = len(cols)
    aggs = [F.avg(c) for c in cols] + [F.covar_pop(cols[i], cols[j]) for i in range(p) for j in range(i, p)]
    n, *stats = known.select(*[F.col(c).cast("double").alias(c) for c in cols]).agg(F.count(F.lit(1)), *aggs).first()
    if not n or not np.isfinite(stats).all():
        return None
    cov = np.zeros((p, p))
    cov[np.triu_indices(p)] = stats[p:]
    cov += np.triu(cov, 1).T
    if not (np.diag(cov) > 0).all() or np.linalg.eigvalsh(correlation(cov[1:, 1:]))[0] < 1e-6:
        return None
    coef = ols(float(n), np.array(stats[:p]), cov, 0, range(1, p))["coef"]
    terms = [F.col(x) * F.lit(float(b)) for x, b in zip(xs, coef[1:])]
    return reduce(lambda a, b: a + b, terms) + F.lit(float(coef[0]))


def impute_regression(df: DataFrame, target: str, predictors: Sequence[str] | None = None) -> DataFrame:
    """Linear model (number) or forest of 50 trees (category) fitted on the rows that know ``target``; fills the others.

    Missing predictors take their mean (number) or an own level (category); without predictors the mean or mode is used.
    """
    others = [c for c in (predictors or df.columns) if c != target]
    if not others:
        return impute_mean_median(df, [target]) if _is_numeric(df, target) else impute_mode_constant(df, [target])
    numeric = [c for c in others if _is_numeric(df, c)]
    texts = [c for c in others if c not in numeric]
    ready = _with_numbers(df, numeric)
    known = F.col(target).isNotNull()
    if _is_numeric(df, target):
        few = not texts and len(numeric) < MOMENT_COLUMNS
        pred = _line(ready.where(known), target, [f"_m_{c}" for c in numeric]) if few else None
        if pred is None:
            ready = _with_features(ready, numeric, texts)
            fit = LinearRegression(featuresCol="_features", labelCol="_y", predictionCol="_pred", solver="normal", regParam=0.0)
            ready = fit.fit(ready.where(known).withColumn("_y", F.col(target).cast("double")).select("_features", "_y")).transform(ready)
            pred = F.col("_pred")
        value = F.coalesce(F.col(target).cast("double"), pred)
    else:
        ready = _with_features(ready, numeric, texts)
        index = StringIndexer(inputCol=target, outputCol="_y", handleInvalid="keep").fit(ready.where(known))
        # the class alone is asked for: without the columns of votes and shares a row is predicted in one call
        fit = RandomForestClassifier(
            featuresCol="_features", labelCol="_y", predictionCol="_pred", rawPredictionCol="", probabilityCol="", numTrees=50, seed=42)
        ready = fit.fit(index.transform(ready.where(known)).select("_features", "_y")).transform(ready)
        labels = F.array(*[F.lit(x) for x in index.labels])
        value = F.coalesce(F.col(target), F.try_element_at(labels, F.col("_pred").cast("int") + 1))
    return ready.select(*[value.alias(c) if c == target else F.col(c) for c in df.columns])


def causal_order(columns: Sequence[str], edges: Sequence[tuple[str, str]]) -> list[str]:
    """Columns with causes before effects; table order when the graph has a cycle."""
    left, order = list(columns), []
    while left:
        free = [c for c in left if not any(d == c and s in left for s, d in edges)]
        if not free:
            return list(columns)
        order += free
        left = [c for c in left if c not in free]
    return order


def impute_causal(df: DataFrame, edges: DataFrame | Sequence[tuple[str, str]], columns: Sequence[str] | None = None) -> DataFrame:
    """Impute along the causal order, every column from its graph parents (or from the columns before it)."""
    cols = list(columns or df.columns)
    pairs = [(r.src, r.dst) for r in edges.collect()] if isinstance(edges, DataFrame) else list(edges)  # p*p at most
    pairs = [(s, d) for s, d in pairs if s in cols and d in cols]
    order = causal_order(cols, pairs)
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    for i, c in enumerate(order):
        if counts[c]:
            parents = [s for s, d in pairs if d == c] or order[:i]
            df = cut_lineage(impute_regression(df, c, parents) if parents else (
                impute_mean_median(df, [c]) if _is_numeric(df, c) else impute_mode_constant(df, [c])))
    return df


def impute_multiple(
    df: DataFrame, key: str, columns: Sequence[str], draws: int = 5, rounds: int = 10, trees: int = 50, seed: int = 42
) -> DataFrame:
    """``draws`` chained-equation imputations by random forests with residual noise, averaged per row.

    The forests are fitted on a pool of about ``chained.POOL`` rows, drawn by a hash of the key; each draw is one task, and its whole chain (``rounds`` times over
    the columns with holes) is then run over every row in one narrow pass. Filled columns become doubles. Keys may repeat: equal keys draw the same noise.
    """
    from .chained import impute

    return impute(df, key, columns, draws, rounds, trees, seed)
