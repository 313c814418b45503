"""Vector bin packing: groups of equal texts go to shards so that bytes, tokens and rows come out level together.

Group totals are added up where the rows are. Groups above a small share of the whole are placed one by one; the rest are folded by hash into bundles
whose sizes fall in steps, so a bounded table (``pieces``, some ten thousand rows whatever the input) reaches the driver, and the last
bundles placed are small enough to level what the first left uneven.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage

#: A group of at least 1/LARGE of all bytes, tokens or rows is placed on its own: at most 3 * LARGE groups.
LARGE = 4_000
#: Bundles of the other groups: LEVELS steps, each with half of what is left, of BUNDLES each.
LEVELS, BUNDLES = 12, 512
#: A group larger than this share of a shard is cut into parts of at most 1/PARTS of a shard.
WHOLE, PARTS = 0.95, 16
#: What each dimension weighs in the dot product: bytes, tokens, rows.
WEIGHTS = (16.0, 1.0, 1.0)
#: Rows numbered by one task, about.
SLOT_ROWS = 5_000


def shard(df: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", overhead: int = 16) -> DataFrame:
    """One row per row of ``df``: key, ``size`` (UTF-8 bytes of the text plus ``overhead``), ``n_tokens``, ``text_crc32``, ``shard``, ``slot``.

    Equal texts stay together unless they outweigh a shard; then they are dealt by a hash of the key into parts. A null text counts as empty. Repeated rows
    are rows of their own, in neighbouring slots; null keys are dealt like any key. Slots count from 0 in each shard without gaps.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(
        df.select(
            F.col(key).alias("_key"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("_size"), _tokens(body).alias("_tokens"),
            F.crc32(body.cast("binary")).alias("_crc"), F.xxhash64(body).alias("_g1"), F.xxhash64(F.lit("second"), body).alias("_g2"),
        )
    )
    groups = rows.groupBy("_g1", "_g2").agg(F.sum("_size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r"))
    groups = cut_lineage(groups)
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btr"]).first()
    b, t, r = (max(1, total[c]) for c in "btr")
    large = (F.col("b") * LARGE >= b) | (F.col("t") * LARGE >= t) | (F.col("r") * LARGE >= r)
    parts = F.greatest(F.lit(1), F.when(F.col("b") > WHOLE * b / shards, F.ceil(F.col("b") * (shards * PARTS) / b))).cast("int")
    own = groups.where(large).select("_g1", "_g2", "b", "t", "r", parts.alias("parts"))
    # parts of the groups that are cut: their rows are counted where they are
    cut = F.broadcast(own.where("parts > 1").select("_g1", "_g2", "parts"))
    pieces = (
        rows.join(cut, ["_g1", "_g2"]).groupBy("_g1", "_g2", _part(F.col("parts")).alias("part"))
        .agg(F.sum("_size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r"))
        .unionByName(own.where("parts = 1").select("_g1", "_g2", F.lit(0).alias("part"), "b", "t", "r"))
    )
    bundles = groups.where(~large).groupBy(_bundle(F.col("_g1")).alias("bundle")).agg(*[F.sum(c).alias(c) for c in "btr"])
    big = pieces.orderBy("_g1", "_g2", "part").collect()  # at most 3 * LARGE groups, and as many parts as shards * PARTS or so more
    small = bundles.orderBy("bundle").collect()  # at most LEVELS * BUNDLES
    place = _place(np.array([[x.b, x.t, x.r] for x in [*big, *small]], float).reshape(-1, 3), shards)
    spark = df.sparkSession
    at_big = spark.createDataFrame([(x._g1, x._g2, x.part, int(s)) for x, s in zip(big, place, strict=False)], "_g1 long, _g2 long, part int, _s1 int")
    at_small = spark.createDataFrame([(x.bundle, int(s)) for x, s in zip(small, place[len(big) :], strict=False)], "_bundle int, _s2 int")
    counts = at_big.groupBy("_g1", "_g2").agg(F.max("part").alias("_last"))
    wide = own.select("_g1", "_g2", "parts")
    placed = (
        rows.join(F.broadcast(wide.join(counts, ["_g1", "_g2"], "left")), ["_g1", "_g2"], "left")
        .withColumn("part", F.when(F.col("parts") > 1, _part(F.col("parts"))).otherwise(F.lit(0)))
        .join(F.broadcast(at_big), ["_g1", "_g2", "part"], "left")
        .withColumn("_bundle", _bundle(F.col("_g1")))
        .join(F.broadcast(at_small), "_bundle", "left")
        .select("_key", "_size", "_tokens", "_crc", "_g1", "_g2", F.coalesce("_s1", "_s2").alias("shard"))
    )
    out = _slots(placed, total["r"] or 0, shards)
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_tokens").alias("n_tokens"), F.col("_crc").alias("text_crc32"), "shard", "slot")


def _tokens(body: Column) -> Column:
    """Words between white space: places where a word begins."""
    return F.regexp_count(body, F.lit(r"[^ \t-\r]+")).cast("long")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), F.col("_key")), parts).cast("int")


def _bundle(group: Column) -> Column:
    """Step k holds 1 of 2^(k+1) groups, the last step the rest; within a step, BUNDLES places."""
    h = F.xxhash64(F.lit("bundle"), group)
    step = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        step = F.when(h.bitwiseAND(F.lit((2 << k) - 1)) == (1 << k), F.lit(k)).otherwise(step)
    return (step * BUNDLES + F.pmod(F.shiftright(h, 32), F.lit(BUNDLES))).cast("int")


def _place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The heaviest first, each to the shard whose residual capacity has the highest dot product with it."""
    if not len(sizes):
        return np.zeros(0, int)
    share = sizes / np.maximum(sizes.sum(axis=0), 1)
    weights = np.array(WEIGHTS)
    left = np.full((shards, 3), 1.0 / shards)
    place = np.zeros(len(sizes), int)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        at = int(np.argmax((left * weights) @ share[i]))
        place[i] = at
        left[at] -= share[i]
    return place


def _slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """Number the rows of each shard from 0: short ranges by hash, numbered one by one, after the count of the ranges before."""
    ranges = max(1, -(-n // (shards * SLOT_ROWS)))
    ranged = rows.withColumn("_range", F.pmod(F.xxhash64("_key", "_g1"), F.lit(ranges)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n")).select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_range").orderBy("_key", "_g1", "_g2")
    numbered = ranged.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_range"]).withColumn("slot", (F.col("_start") + F.col("_at")).cast("long"))
