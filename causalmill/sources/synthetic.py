"""Random structural models: a DAG and data sampled from it."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_dag(n_vars: int, density: float, seed: int) -> list[tuple[int, int, float]]:
    """Edges i -> j (i < j) kept with probability ``density``; weights in ±[0.5, 1.5]."""
    rng = random.Random(seed)
    edges = []
    for j in range(n_vars):
        for i in range(j):
            if rng.random() < density:
                edges.append((i, j, rng.choice([-1, 1]) * rng.uniform(0.5, 1.5)))
    return edges


def synthetic_scm(
    spark: SparkSession,
    rows: int,
    n_vars: int = 5,
    density: float = 0.3,
    kind: str = "linear",
    noise: float = 1.0,
    seed: int = 42,
    edges: list[tuple[int, int, float]] | None = None,
    uniform_noise: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(data with ``id``, X0…; edge table) for kind linear, nonlinear, discrete or mixed."""
    dag = random_dag(n_vars, density, seed) if edges is None else edges
    df = spark.range(rows)
    for j in range(n_vars):
        draw = (F.rand(seed + j) - 0.5) * 3.4641016151377544 if uniform_noise else F.randn(seed + j)
        value = draw * F.lit(noise)
        for n, (i, _, w) in enumerate(e for e in dag if e[1] == j):
            x = F.col(f"X{i}").cast("double")
            if kind == "nonlinear":
                x = [F.sin(x), F.exp(F.greatest(F.least(x, F.lit(10.0)), F.lit(-10.0)) / 5.0), x * x][n % 3]
            value = value + F.lit(w) * x
        if kind == "discrete" or (kind == "mixed" and j % 2 == 1):
            levels = 2 + j % 3
            # logit of the latent value cut into equal probability steps
            share = 1.0 / (1.0 + F.exp(-value))
            value = F.least(F.floor(share * levels), F.lit(levels - 1)).cast("int")
        df = df.withColumn(f"X{j}", value)
    table = spark.createDataFrame([(f"X{i}", f"X{j}", float(w)) for i, j, w in dag] or [], "src string, dst string, weight double")
    return df, table
