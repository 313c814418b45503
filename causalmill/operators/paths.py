"""Sums over all directed paths between pairs of nodes, of any length, without listing a path.

The graph between the ends is acyclic, so every walk from source to target is a path, and what is asked of the paths (how many, how strong, how long)
adds up along the edges: one round per length carries the sums of that length one edge further, forward from the source and backward from the target at
once. A node holds as many rows as there are lengths of paths to it; the number of paths, which grows exponentially, only shows as a number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_ROWS
from ..functions.lineage import cut_lineage, row_bound
from .graph import EDGE, G, all_simple_paths, reach

PAIR = [G, "source", "target"]
COUNT = "decimal(38,0)"


def edges_between(edges: DataFrame, ends: DataFrame, weight: str = "weight") -> DataFrame:
    """(graph_id, source, target, src, dst, w): the edges from which the target, and which from the source, can be reached.

    A missing weight counts as 1, of repeated edges the heaviest counts; self loops are left out.
    """
    pairs = cut_lineage(ends.select(*PAIR).where("source != target").distinct())
    w = F.coalesce(F.max(F.col(weight)).cast("double"), F.lit(1.0)) if weight in edges.columns else F.lit(1.0)
    steps = cut_lineage(edges.where("src != dst").groupBy(*EDGE).agg(w.alias("w")))
    down = reach(steps, pairs.select(G, F.col("source").alias("node")).distinct()).select(G, F.col("seed").alias("source"), "node")
    up = reach(steps, pairs.select(G, F.col("target").alias("node")).distinct(), backward=True).select(G, F.col("seed").alias("target"), "node")
    below = pairs.join(down, [G, "source"]).select(*PAIR, "node").unionByName(pairs.select(*PAIR, F.col("source").alias("node")))
    above = pairs.join(up, [G, "target"]).select(*PAIR, "node").unionByName(pairs.select(*PAIR, F.col("target").alias("node")))
    on = cut_lineage(below.intersect(above))
    one, two = on.withColumnRenamed("node", "src"), on.withColumnRenamed("node", "dst")
    return steps.join(one, [G, "src"]).join(two, [*PAIR, "dst"]).select(*PAIR, "src", "dst", "w")


def path_sums(edges: DataFrame, ends: DataFrame, weight: str = "weight") -> DataFrame:
    """Per pair of ends, direction, node and length: ``paths``, ``strength`` (sum of the products of weights), ``top`` and ``low`` (greatest, least product).

    ``forward`` rows sum the paths from the source to the node, the others those from the node to the target. The graph between the ends must be acyclic.
    """
    between = cut_lineage(edges_between(edges, ends, weight))
    ahead = between.select(*PAIR, F.lit(True).alias("forward"), F.col("src").alias("node"), F.col("dst").alias("next"), "w")
    moves = cut_lineage(ahead.unionByName(between.select(*PAIR, F.lit(False).alias("forward"), F.col("dst").alias("node"), F.col("src").alias("next"), "w")))
    moves = F.broadcast(moves) if row_bound(moves, BROADCAST_ROWS) <= BROADCAST_ROWS else moves
    most = between.groupBy(*PAIR).agg(F.count_distinct("src").alias("n")).agg(F.max("n")).first()[0] or 0  # a longer walk than this meets a node twice
    start = between.select(*PAIR).distinct()
    one = [F.lit(1).cast(COUNT).alias("paths"), *[F.lit(1.0).alias(c) for c in ("strength", "top", "low")]]
    begin = start.select(*PAIR, F.lit(True).alias("forward"), F.col("source").alias("node"), F.lit(0).alias("length"), *one)
    delta = cut_lineage(begin.unionByName(start.select(*PAIR, F.lit(False).alias("forward"), F.col("target").alias("node"), F.lit(0).alias("length"), *one)))
    done = [delta]
    while True:
        up, down = F.col("top") * F.col("w"), F.col("low") * F.col("w")
        grown = delta.join(moves, [*PAIR, "forward", "node"]).groupBy(*PAIR, "forward", F.col("next").alias("node")).agg(
            (F.first("length") + 1).alias("length"), F.sum("paths").cast(COUNT).alias("paths"), F.sum(F.col("strength") * F.col("w")).alias("strength"),
            F.max(F.greatest(up, down)).alias("top"), F.min(F.least(up, down)).alias("low"),
        )
        delta = cut_lineage(grown)  # each round writes its own length only
        if delta.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if len(done) > most:
            raise ValueError("the graph between the ends has a cycle; list its simple paths instead")
        done.append(delta)


def _share(value, total):
    return F.when(total > 0, value / total).otherwise(value)


def path_lengths(sums: DataFrame) -> DataFrame:
    """(graph_id, source, target, length, paths): how many paths of each length there are; pairs without a path are left out."""
    return sums.where("forward and node = target").select(*PAIR, "length", "paths")


def path_summary(sums: DataFrame) -> DataFrame:
    """One row per pair of ends with a path: counts, direct effect, lengths, mediators, and the share of the strongest path in the sum of all."""
    whole = sums.where("forward and node = target").groupBy(*PAIR).agg(
        F.sum("paths").cast(COUNT).alias("paths"), F.bool_or(F.col("length") == 1).alias("has_direct"), F.coalesce(F.sum(F.when(F.col("length") > 1, F.col("paths"))), F.lit(0)).cast(COUNT).alias("indirect"),
        F.min("length").alias("shortest"), F.max("length").alias("longest"), _share(F.max("top"), F.sum("strength")).alias("top_probability"),
    )
    inner = sums.where("forward and node != source and node != target").groupBy(*PAIR).agg(F.array_sort(F.collect_set("node")).alias("mediators"))
    return whole.join(inner, PAIR, "left").withColumn("mediators", F.coalesce("mediators", F.array().cast("array<string>")))


def mediators(sums: DataFrame) -> DataFrame:
    """(graph_id, source, target, node, paths_count, importance): paths through each inner node, and their share of the strength of all paths."""
    side = lambda forward, name: sums.where(F.col("forward") == forward).groupBy(*PAIR, "node").agg(F.sum("paths").cast(COUNT).alias(f"{name}_paths"), F.sum("strength").alias(f"{name}_strength"))
    total = sums.where("forward and node = target").groupBy(*PAIR).agg(F.sum("strength").alias("total"))
    both = side(True, "to").join(side(False, "from"), [*PAIR, "node"]).where("node != source and node != target").join(total, PAIR)
    importance = _share(F.col("to_strength") * F.col("from_strength"), F.col("total"))
    return both.select(*PAIR, "node", (F.col("to_paths") * F.col("from_paths")).cast(COUNT).alias("paths_count"), importance.alias("importance"))


def path_edges_of(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges on a path between any pair of ``ends``, with all their columns."""
    return edges.join(edges_between(edges, ends).select(*EDGE).distinct(), EDGE, "left_semi").select(edges.columns)


def listed_paths(edges: DataFrame, ends: DataFrame, max_length: int) -> DataFrame:
    """The simple paths of at most ``max_length`` edges, each with that limit and ``left_out``, the number of longer paths between its ends."""
    longer = path_lengths(path_sums(edges, ends)).where(F.col("length") > max_length).groupBy(*PAIR).agg(F.sum("paths").cast(COUNT).alias("left_out"))
    found = all_simple_paths(edges, ends, max_length).join(longer, PAIR, "left")
    return found.withColumns({"max_length": F.lit(max_length), "left_out": F.coalesce("left_out", F.lit(0).cast(COUNT))})
