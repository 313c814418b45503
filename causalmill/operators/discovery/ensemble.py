"""Agreement between the graphs of several runs or methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EDGE, G


def ensemble_vote(edges: DataFrame, run: str = "run", threshold: float = 0.5, directions: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst, share, kind, bidirected): share of the runs of a graph that hold the edge.

    conflict: both directions reach the threshold; common: this one does; unique: neither does. ``directions`` (graph_id, src,
    dst, direction forward/backward/bidirected) settles conflicts, the others stay bidirected.
    """
    runs = edges.groupBy(G).agg(F.count_distinct(run).alias("_t"))
    share = edges.select(*EDGE, run).distinct().groupBy(*EDGE).agg(F.count(F.lit(1)).alias("_c")).join(runs, G)
    share = share.where("src != dst").select(*EDGE, (F.col("_c") / F.col("_t")).alias("share"))
    other = share.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("share").alias("_o"))
    j = share.join(other, EDGE, "left").withColumn("_o", F.coalesce("_o", F.lit(0.0)))
    mine, back = F.col("share") >= threshold, F.col("_o") >= threshold
    kind = F.when(mine & back, "conflict").when(mine, "common").when(back, "reversed").otherwise("unique")
    out = j.select(*EDGE, "share", kind.alias("kind")).where("kind != 'reversed'")
    if directions is None:
        return out.withColumn("bidirected", F.col("kind") == "conflict")
    d = directions.select(*EDGE, "direction")
    turn = F.when(F.col("direction") == "forward", "backward").when(F.col("direction") == "backward", "forward").otherwise(F.col("direction"))
    both = d.unionByName(d.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), turn.alias("direction")))
    settled = out.join(both, EDGE, "left").where("kind != 'conflict' OR direction IS NULL OR direction IN ('forward', 'bidirected')")
    return settled.select(*EDGE, "share", "kind", ((F.col("kind") == "conflict") & (F.coalesce("direction", F.lit("bidirected")) == "bidirected")).alias("bidirected"))


def method_agreement(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, weight, methods, agreement): greatest weight and the sorted methods that found the edge."""
    return edges.groupBy(*EDGE).agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("method")).alias("methods")).withColumn("agreement", F.size("methods"))
