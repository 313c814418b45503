"""Append-only tables of analysis runs: ``runs``, ``run_edges`` and ``run_refinements``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, root: str, table: str) -> int:
    """Append rows to one of the run tables under ``root``; how many, as observed by the write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(f"{root}/{table}")
    return seen.get["rows"]


def append_graph(runs: DataFrame, edges: DataFrame, root: str) -> dict[str, int]:
    """Store run rows with node and edge counts taken from their edge table (keyed by ``run_id``); the rows written to each table."""
    ends = edges.select("run_id", F.explode(F.array("src", "dst")).alias("node"))
    nodes = ends.groupBy("run_id").agg(F.count_distinct("node").alias("nodes_count"))
    counts = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges_count")).join(nodes, "run_id")
    zero = F.lit(0).cast("long")
    full = runs.join(counts, "run_id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("nodes_count", "edges_count")}
    )
    return {"runs": append(full, root, "runs"), "run_edges": append(edges, root, "run_edges")}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


def recent(runs: DataFrame, k: int = 5) -> DataFrame:
    """Newest ``k`` runs; ties go to the greater run id."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(k)


def statistics(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per status and total time of every run."""
    keys = by or ["run_id"]
    return steps.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("execution_time").alias("total_time"), F.max("execution_time").alias("slowest")
    )
