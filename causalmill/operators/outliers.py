"""Outlier flags, removal and replacement."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut_lineage
from ..functions.quantiles import collect_quantiles, modes
from .scaling import _moments


def _zscore_flags(df: DataFrame, columns: Sequence[str], threshold: float) -> dict:
    stats = _moments(df, columns, F.avg, F.stddev_pop)
    flags = {}
    for c, (m, s) in stats.items():
        far = F.abs(F.col(c) - F.lit(m)) / F.lit(s) > threshold if s else F.lit(False)
        flags[c] = F.coalesce(far, F.lit(False))
    return flags


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float) -> dict[str, tuple[float, float]]:
    qs = collect_quantiles(df, columns, [0.25, 0.75])
    return {c: (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0])) for c, q in qs.items() if q[0] is not None}


def _iqr_flags(columns: Sequence[str], bounds: dict) -> dict:
    flags = {}
    for c in columns:
        if c in bounds:
            flags[c] = F.coalesce((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1]), F.lit(False))
        else:
            flags[c] = F.lit(False)
    return flags


def outlier_zscore(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Boolean ``{col}_is_outlier``: |x - mean| / population std above the threshold."""
    return df.withColumns({f"{c}_is_outlier": f for c, f in _zscore_flags(df, columns, threshold).items()})


def outlier_iqr(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Boolean ``{col}_is_outlier`` outside the quartile fences; the fences come as ``{col}_lower`` and ``{col}_upper``."""
    bounds = iqr_bounds(df, columns, factor)
    out = df.withColumns({f"{c}_is_outlier": f for c, f in _iqr_flags(columns, bounds).items()})
    return out.withColumns({f"{c}_{side}": F.lit(b[i]) for c, b in bounds.items() for i, side in enumerate(("lower", "upper"))})


def outlier_remove_rows(df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Rows inside the limits in every column; a missing value fails the row."""
    if method == "zscore":
        flags = _zscore_flags(df, columns, threshold)
    else:
        flags = _iqr_flags(columns, iqr_bounds(df, columns, threshold))
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~flags[c]
    return df.where(keep)


def outlier_replace(
    df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0, strategy: str = "clip"
) -> DataFrame:
    """Replace flagged values: clip to the limits (z-score limits use the sample std), or mean, median, mode."""
    if method == "zscore":
        flags = _zscore_flags(df, columns, threshold)
        limits = {c: (m - threshold * (s or 0.0), m + threshold * (s or 0.0)) for c, (m, s) in _moments(df, columns, F.avg, F.stddev_samp).items() if m is not None}
    else:
        limits = iqr_bounds(df, columns, threshold)
        flags = _iqr_flags(columns, limits)
    if strategy == "mean":
        fills = {c: v[0] for c, v in _moments(df, columns, F.avg).items()}
    elif strategy == "median":
        fills = {c: q[0] for c, q in collect_quantiles(df, columns, [0.5]).items()}
    elif strategy == "mode":
        fills = {r["column"]: r["value"] for r in modes(df, columns).collect()}
    elif strategy != "clip":
        raise ValueError(f"unknown strategy: {strategy}")
    new = {}
    for c in columns:
        if strategy == "clip":
            value = F.least(F.greatest(F.col(c), F.lit(limits[c][0])), F.lit(limits[c][1])) if c in limits else F.col(c)
        else:
            value = F.lit(fills.get(c))
        new[c] = F.when(flags[c], value).otherwise(F.col(c).cast("double"))
    return df.withColumns(new)


def outlier_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, z_count, iqr_count, percent, lower, upper, overall_percent) of columns where both rules find outliers and
    the quartile rule flags more than 0.1 %."""
    bounds = iqr_bounds(df, columns, 1.5)
    zf, qf = _zscore_flags(df, columns, 3.0), _iqr_flags(columns, bounds)
    cols = [c for c in columns if c in bounds]
    row = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.count(F.when(zf[c], 1)).alias(f"z{i}") for i, c in enumerate(cols)],
        *[F.count(F.when(qf[c], 1)).alias(f"q{i}") for i, c in enumerate(cols)],
    )
    recs = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"z{i}").alias("z_count"), F.col(f"q{i}").alias("iqr_count"), F.col(f"n{i}").alias("n"),
            (F.col(f"q{i}") * 100.0 / F.col(f"n{i}")).alias("percent"), F.lit(bounds[c][0]).alias("lower"), F.lit(bounds[c][1]).alias("upper"),
        )
        for i, c in enumerate(cols)
    ]
    long = row.select(F.inline(F.array(*recs))).where((F.col("z_count") > 0) & (F.col("iqr_count") > 0) & (F.col("percent") > 0.1))
    total = long.agg((F.sum("iqr_count") * 100.0 / F.sum("n")).alias("overall_percent"))
    return long.withColumn("_k", F.lit(0)).join(F.broadcast(total.withColumn("_k", F.lit(0))), "_k").drop("_k", "n")


_EULER = 0.5772156649015329


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow_tree(x: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple]:
    """Random splits as a flat node list: (feature, split, left, right) or (-1, depth + expected rest, 0, 0)."""
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        wide = np.nonzero(hi > lo)[0]
        if depth >= height or len(rows) <= 1 or not len(wide):
            nodes[at] = (-1, depth + float(_average_path(np.array(len(rows)))), 0, 0)
            return at
        f = int(rng.choice(wide))
        s = float(rng.uniform(lo[f], hi[f]))
        left = grow(rows[rows[:, f] < s], depth + 1)
        right = grow(rows[rows[:, f] >= s], depth + 1)
        nodes[at] = (f, s, left, right)
        return at

    grow(x, 0)
    return nodes


def outlier_isolation_forest(
    df: DataFrame, columns: Sequence[str], key: str, contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """``anomaly_score`` and ``is_outlier`` (the ``contamination`` share with the highest scores); a row with a missing value has no score and is no outlier.

    Each tree is grown by one task from its own ``sample`` rows; scoring walks the trees over Arrow batches of the whole rows, so keys may repeat. The forest
    holds at most ``trees * 2 * sample`` nodes, so sending it to the executors is bounded whatever the table length.
    """
    names = list(columns)
    known = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    n = known.count()
    # a row draws into how many trees it goes (binomial, by a hash, so a recomputed task draws the same), and only then, if any, into which
    p = min(1.0, 1.3 * sample / max(n, 1))
    cdf = np.minimum(np.cumsum([math.comb(trees, i) * p**i * (1 - p) ** (trees - i) for i in range(trees + 1)]), 1.0)
    u = F.pmod(F.xxhash64("_key", *names, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    many = F.size(F.filter(F.lit([float(c) for c in cdf]), lambda c: c <= u))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(F.col("_key"), *names, t, F.lit(seed + 1)).alias("h"), t.alias("tree"))))
    sampled = known.withColumn("_many", F.when(u < F.lit(float(cdf[0])), 0).otherwise(F.least(many, F.lit(trees)))).where("_many > 0").select("_key", *names, F.inline(F.slice(ranked, F.lit(1), F.col("_many"))))
    height = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(["h", *names]).head(sample)[names].to_numpy(dtype=float)
        nodes = _grow_tree(rows, np.random.default_rng(seed + t), height)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right"])
        return out.assign(tree=t, node=range(len(nodes)), rows=len(rows))

    schema = "tree int, node int, feature int, split double, left int, right int, rows int"
    nodes = sampled.groupBy("tree").applyInPandas(grow, schema).toPandas()  # trees * 2 * sample rows at most
    forest = []
    for _, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        leaf = g["feature"].to_numpy() < 0
        own = np.arange(len(g))
        # a leaf leads to itself, so every row walks the same number of steps
        forest.append((
            np.where(leaf, 0, g["feature"].to_numpy()), np.where(leaf, np.inf, g["split"].to_numpy()),
            np.where(leaf, own, g["left"].to_numpy()), np.where(leaf, own, g["right"].to_numpy()), g["split"].to_numpy(), int(g["rows"].iloc[0]),
        ))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns - len(names), batch.num_columns)])
            row = np.arange(len(x))
            depth, size = np.zeros(len(x)), 0
            for feature, split, left, right, path, rows in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(height + 1):
                    at = np.where(x[row, feature[at]] < split[at], left[at], right[at])
                depth += path[at]
                size = max(size, rows)
            norm = float(_average_path(np.array(size))) or 1.0
            found = pa.array(2.0 ** (-depth / max(len(shared.value), 1) / norm), pa.float64(), mask=np.isnan(x).any(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - len(names)], found], names=[*batch.schema.names[: batch.num_columns - len(names)], "anomaly_score"])

    staged = df.select("*", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    scores = cut_lineage(staged.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField("anomaly_score", T.DoubleType())])))
    cut = collect_quantiles(scores, ["anomaly_score"], [1.0 - contamination])["anomaly_score"][0]
    return scores.withColumn("is_outlier", F.coalesce(F.col("anomaly_score") > F.lit(cut).cast("double"), F.lit(False)))


def outlier_dbscan(df: DataFrame, columns: Sequence[str], key: str | None = None, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``is_outlier`` = DBSCAN noise on standardised columns (rows with a missing value are noise).

    Equal points are looked at once, with their number, and rows find their flag by their point: ``key`` is not needed and may repeat.
    """
    from .neighbours import density_noise

    stats = _moments(df, columns, F.avg, F.stddev_pop)
    dims = [f"_x{i}" for i in range(len(columns))]
    # + 0.0 makes one zero of the two, so that equal points are one
    scaled = df.withColumns({x: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) + F.lit(0.0) for x, (c, (m, s)) in zip(dims, stats.items())})
    points = scaled.select(*dims).na.drop().groupBy(*dims).agg(F.count(F.lit(1)).alias("_w"))
    noise = density_noise(points, dims, eps, min_samples)
    return scaled.join(noise, dims, "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(True))).drop(*dims)
