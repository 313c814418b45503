"""Chained-equation imputation: forests are fitted draw by draw on a bounded pool of rows, and their chain is run over every row of the table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows the forests are fitted on, drawn by hash from the whole table; bins of a column; levels of a tree; least weight of a leaf.
POOL, BINS, DEPTH, LEAF = 16_384, 32, 5, 5.0
NODES = 2 ** (DEPTH + 1) - 1


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A regression tree on binned columns as a heap: column, last bin that goes left, value. Every level is split from one histogram of sums."""
    column, cut, value = np.zeros(NODES, np.int64), np.full(NODES, BINS), np.zeros(NODES)
    node = np.zeros(len(y), np.int64)
    value[0] = np.average(y, weights=weight) if weight.sum() else 0.0
    for level in range(DEPTH):
        first, wide = 2**level - 1, 2**level
        best = np.zeros(wide)
        own = np.bincount(node - first, weight, wide)
        sums = np.bincount(node - first, weight * y, wide)
        base = sums**2 / np.maximum(own, 1e-300)
        for f in range(codes.shape[1]):
            place = (node - first) * BINS + codes[:, f]
            w = np.cumsum(np.bincount(place, weight, wide * BINS).reshape(wide, BINS), axis=1)
            s = np.cumsum(np.bincount(place, weight * y, wide * BINS).reshape(wide, BINS), axis=1)
            rest = own[:, None] - w
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((w >= LEAF) & (rest >= LEAF), s**2 / w + (sums[:, None] - s) ** 2 / rest - base[:, None], 0.0)
            at = gain.argmax(axis=1)
            top = gain[np.arange(wide), at]
            better = top > best + 1e-12
            best = np.where(better, top, best)
            column[first : first + wide][better] = f
            cut[first : first + wide][better] = at[better]
        node = 2 * node + 1 + (codes[np.arange(len(y)), column[node]] > cut[node])
        below = 2**level * 2
        w, s = np.bincount(node - (2 * first + 1), weight, below), np.bincount(node - (2 * first + 1), weight * y, below)
        parent = value[(np.arange(below) + 2 * first) // 2]
        value[2 * first + 1 : 2 * first + 1 + below] = np.where(w > 0, s / np.maximum(w, 1e-300), parent)
    return column, cut, value


def predict(forest: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Mean over the trees of a forest (arrays of trees x nodes)."""
    column, cut, value = forest
    total, row = np.zeros(len(codes)), np.arange(len(codes))
    for c, b, v in zip(column, cut, value):
        node = np.zeros(len(codes), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (codes[row, c[node]] > b[node])
        total += v[node]
    return total / len(column)


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])


def fit_chain(x: np.ndarray, holes: list[int], start: np.ndarray, edges: list[np.ndarray], rounds: int, trees: int, seed: int) -> list[tuple[int, tuple, float]]:
    """The steps of one draw: (column, forest on the others, spread of its residuals), ``rounds`` times over the columns with holes."""
    rng = np.random.default_rng(seed)
    missing = np.isnan(x)
    x = np.where(missing, start, x)
    steps = []
    for _ in range(rounds):
        for j in holes:
            others = [i for i in range(x.shape[1]) if i != j]
            codes = coded(x[:, others], [edges[i] for i in others])
            known = np.flatnonzero(~missing[:, j])
            if len(known):
                grown = [grow(codes[known], x[known, j], np.bincount(rng.integers(0, len(known), len(known)), minlength=len(known)).astype(float)) for _ in range(trees)]
            else:
                grown = [(np.zeros(NODES, np.int64), np.full(NODES, BINS), np.full(NODES, start[j]))]
            forest = tuple(np.stack(part) for part in zip(*grown))
            found = predict(forest, codes)
            spread = float(np.std(x[known, j] - found[known])) if len(known) else 0.0
            steps.append((j, forest, spread))
            x[missing[:, j], j] = (found + rng.standard_normal(len(x)) * spread)[missing[:, j]]
    return steps


def _normal(hashes: np.ndarray, step: int) -> np.ndarray:
    """Normal numbers fixed by the row's hash and the step, so that a task that is run again draws the same."""
    def uniform(salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = hashes.astype(np.uint64) + np.uint64((2 * step + salt) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        return ((z >> np.uint64(11)).astype(float) + 0.5) / 2**53

    return np.sqrt(-2.0 * np.log(uniform(1))) * np.cos(2.0 * np.pi * uniform(2))


def impute(df: DataFrame, key: str, columns: Sequence[str], draws: int, rounds: int, trees: int, seed: int) -> DataFrame:
    """See ``missing.impute_multiple``."""
    cols, p = list(columns), len(columns)
    clean = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"_x{i}") for i, c in enumerate(cols)]
    vals = df.select(F.xxhash64(F.lit(seed), f"`{key}`").alias("_h"), *clean)
    facts = vals.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_x{i}").alias(f"m{i}") for i in range(p)], *[F.count(f"_x{i}").alias(f"k{i}") for i in range(p)]).first()
    holes = [i for i in range(p) if facts[f"k{i}"] < facts["n"]]
    if not holes:
        return df
    start = np.array([facts[f"m{i}"] if facts[f"m{i}"] is not None else np.nan for i in range(p)])
    usable = [i for i in range(p) if facts[f"k{i}"]]  # a column without any value stays empty
    holes = [i for i in holes if i in usable]
    share = min(1.0, POOL / max(facts["n"], 1))
    few = vals.where(F.pmod("_h", F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("_h", *[f"_x{i}" for i in usable])
    few = few.orderBy("_h", *[f"_x{i}" for i in usable]).limit(2 * POOL)  # POOL rows are expected

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """One draw; every draw reads the same pool."""
        d = int(pdf["draw"].iloc[0])
        x = pdf.sort_values([c for c in pdf.columns if c != "draw"])[[f"_x{i}" for i in usable]].to_numpy(dtype=float)
        edges = [np.unique(np.quantile(x[~np.isnan(x[:, j]), j], np.arange(1, BINS) / BINS)) if (~np.isnan(x[:, j])).any() else np.zeros(0) for j in range(len(usable))]
        steps = fit_chain(x, [usable.index(i) for i in holes], start[usable], edges, rounds, trees, seed + d)
        out = [(d, -1 - j, [], [], e.tolist(), 0.0) for j, e in enumerate(edges)]
        out += [(d, k * len(usable) + j, f[0].ravel().tolist(), f[1].ravel().tolist(), f[2].ravel().tolist(), s) for k, (j, f, s) in enumerate(steps)]
        return pd.DataFrame(out, columns=["draw", "step", "feature", "cut", "value", "spread"])

    each = few.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    models = each.groupBy("draw").applyInPandas(fit, "draw int, step int, feature array<int>, cut array<int>, value array<double>, spread double").collect()
    chains = []
    for d in range(draws):  # draws * rounds * columns * trees * NODES numbers, whatever the table length
        mine = {r["step"]: r for r in models if r["draw"] == d}
        edges = [np.array(mine[-1 - j]["value"]) for j in range(len(usable))]
        shape = lambda v, kind: np.array(v, kind).reshape(-1, NODES)
        chains.append((edges, [(s % len(usable), (shape(r["feature"], np.int16), shape(r["cut"], np.int16), shape(r["value"], float)), r["spread"]) for s, r in sorted(mine.items()) if s >= 0]))
    shared = df.sparkSession.sparkContext.broadcast(chains)

    columns_all, width = list(df.columns), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(width + 1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(usable))])
            todo = np.flatnonzero(np.isnan(x).any(axis=1))
            hashes = batch.column(width).to_numpy(zero_copy_only=False)[todo]
            part = x[todo]
            missing, total = np.isnan(part), np.zeros_like(part)
            for d, (edges, steps) in enumerate(shared.value if len(todo) else []):
                now = np.where(missing, start[usable], part)
                for k, (j, forest, spread) in enumerate(steps):
                    rows = np.flatnonzero(missing[:, j])
                    if len(rows):
                        others = [i for i in range(len(usable)) if i != j]
                        found = predict(forest, coded(now[np.ix_(rows, others)], [edges[i] for i in others]))
                        now[rows, j] = found + _normal(hashes[rows], d * len(steps) + k) * spread
                total += now
            x[todo] = np.where(missing, total / draws, part)
            filled = {cols[i]: pa.array(x[:, usable.index(i)]) for i in holes}
            yield pa.RecordBatch.from_arrays([filled.get(n, batch.column(i)) for i, n in enumerate(columns_all)], names=columns_all)

    names = {cols[i] for i in holes}
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in names else f for f in df.schema.fields])
    staged = df.select("*", F.xxhash64(F.lit(seed), f"`{key}`").alias("_h"), *[c for i, c in enumerate(clean) if i in usable])
    return staged.mapInArrow(run, schema)
