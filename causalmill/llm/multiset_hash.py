"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs. Each paragraph is hashed to a wide vector, and the vectors are summed modulo powers of two: the order of paragraphs
does not matter, and one is put in or taken out by adding or subtracting its vector. A vector has a count of sentences, DENSE lanes of the
whole paragraph (equality), and COUNTERS small counters, each of the sentences whose hash falls on it: how far the counters of two texts are apart tells
how many sentences differ. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage

#: Lanes of 32 bits of the whole paragraph; lanes of packed counters, counters of a lane and their bits.
DENSE, LANES, PACKED, BITS = 8, 64, 3, 20
COUNTERS, FIELD = LANES * PACKED, (1 << BITS) - 1
WHOLE = (1 << (PACKED * BITS)) - 1
#: Rows between two cuts of the key order, about; the most cuts, which bounds what is sent to the executors; quantiles of the key.
CUT_ROWS, MOST_CUTS, QUANTILES = 2_000, 100_000, 128


def vectors(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Per group ``by`` (a row of ``df``, or rows whose texts are put together): ``n`` sentences, ``dense`` and ``sampled`` lanes (arrays)."""
    body = F.coalesce(F.col(text), F.lit(""))
    par = df.select(*by, F.explode_outer(F.array_remove(F.split(body, "\n"), "")).alias("_par"))
    par = par.withColumn("_own", F.xxhash64("_par"))
    sen = par.select(*by, "_own", F.posexplode_outer(F.split("_par", r"(?<=[.!?]) ")).alias("_at", "_sen"))
    sen = sen.select(*by, F.when(F.col("_at") == 0, F.col("_own")).alias("_own"), F.when(F.col("_sen").isNotNull(), F.xxhash64("_sen")).alias("_h"))
    place = F.pmod("_h", F.lit(COUNTERS))
    sen = sen.select(*by, "_own", "_h", F.floor(place / PACKED).cast("int").alias("_lane"), F.expr(f"shiftleft(1L, {BITS} * cast(pmod(_h, {COUNTERS}) % {PACKED} AS int))").alias("_one"))
    lanes = [F.sum(F.when(F.col("_own").isNotNull(), F.xxhash64("_own", F.lit(100 + j)).bitwiseAND(F.lit(0xFFFFFFFF)))) for j in range(DENSE)]
    counts = [F.sum(F.when(F.col("_lane") == j, F.col("_one"))) for j in range(LANES)]
    agg = sen.groupBy(*by).agg(F.count("_h").alias("n"), *[x.alias(f"_d{j}") for j, x in enumerate(lanes)], *[x.alias(f"_s{j}") for j, x in enumerate(counts)])
    return agg.select(
        *by, "n",
        F.array(*[F.coalesce(F.col(f"_d{j}"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(DENSE)]).alias("dense"),
        F.array(*[F.coalesce(F.col(f"_s{j}"), F.lit(0)).bitwiseAND(F.lit(WHOLE)) for j in range(LANES)]).alias("counts"),
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector (struct n, dense, counts) of the texts of ``a`` and ``b`` together; with sign -1, of ``a`` without the paragraphs of ``b``."""

    def lane(mask: int):
        return lambda x, y: (x + sign * y).bitwiseAND(F.lit(mask))

    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"), F.zip_with(a["dense"], b["dense"], lane(0xFFFFFFFF)).alias("dense"),
        F.zip_with(a["counts"], b["counts"], lane(WHOLE)).alias("counts"),
    )


def _fields(lane: Column) -> list[Column]:
    return [F.shiftrightunsigned(lane, BITS * i).bitwiseAND(F.lit(FIELD)) for i in range(PACKED)]


def fingerprint(v: Column) -> Column:
    """A vector as hexadecimal digits: count, dense lanes, counters modulo 256."""

    def digits(x: Column, n: int) -> Column:
        return F.lower(F.lpad(F.hex(x), n, "0"))

    counters = F.transform(v["counts"], lambda x: F.concat(*[digits(f.bitwiseAND(F.lit(255)), 2) for f in _fields(x)]))
    return F.concat(digits(v["n"], 8), F.concat_ws("", F.transform(v["dense"], lambda x: digits(x, 8))), F.concat_ws("", counters))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of shared / all sentences from two vectors; 1 if they are equal, and for two empty texts.

    The distance of the counters is the number of differing sentences, less those that meet on a counter from both sides: with p and q that only one text
    has, about 2 p q / COUNTERS. Where most counters are apart, the squares, which grow with the number of differing sentences, give the better estimate.
    """
    apart = F.flatten(F.zip_with(a["counts"], b["counts"], lambda x, y: F.array(*[i - j for i, j in zip(_fields(x), _fields(y), strict=True)])))
    sums = F.transform(F.array(apart), lambda d: F.struct(
        F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + F.abs(x)).cast("double").alias("l1"), F.aggregate(d, F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("l2"),
        F.size(F.filter(d, lambda x: x == 0)).alias("alike"),
    ))[0]
    more = (a["n"] - b["n"]).cast("double")
    both = (a["n"] + b["n"]).cast("double")

    def share(s: Column) -> Column:
        met = s["l1"] + (s["l1"] + more) * (s["l1"] - more) / 2 / COUNTERS
        differ = F.when(3 * s["alike"] < COUNTERS, F.greatest(met, s["l2"] - more * more / COUNTERS)).otherwise(met)
        differ = F.least(F.greatest(differ, F.abs(more)), both)
        return F.coalesce(F.try_divide(both - differ, both + differ), F.lit(0.0))

    same = (a["n"] == b["n"]) & (a["dense"] == b["dense"])
    return F.when(same, F.lit(1.0)).otherwise(F.transform(F.array(sums), share)[0])


def with_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row with the text of the row with the next lower key (after the lowest: the highest): ``_bucket _key _text _next``.

    Keys are whole numbers. Ties go by text; a null key comes last. The key order is cut into stretches that are sorted apart, and the first row of each
    stretch is sent to the end of the one before it, so texts are shuffled once.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number, not {df.schema[key].dataType.simpleString()}")
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_k"))
    keys = rows.select("_k")
    n = keys.count()
    cells = max(1, -(-min(n // CUT_ROWS, MOST_CUTS) // QUANTILES))
    bounds = sorted({int(x) for x in keys.where(F.col("_k") > -(2**63)).approxQuantile("_k", [i / QUANTILES for i in range(QUANTILES + 1)], 0.002)}) if n else []
    rows = rows.withColumn("_bucket", _bucket(bounds, cells))
    # the highest key of each stretch, and the stretch that comes before it in descending order
    tops = cut_lineage(rows.groupBy("_bucket").agg(F.max("_k").alias("_top")))
    order = Window.orderBy(F.desc("_top"))
    last = Window.orderBy(F.desc("_top")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("_top", F.coalesce(F.lag("_bucket").over(order), F.last("_bucket").over(last)).alias("_target"))
    rows = rows.join(F.broadcast(tops), F.col("_k") == F.col("_top"), "left")  # at most QUANTILES + MOST_CUTS rows
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_target").alias("b"), F.lit(1).alias("guest"))
    rows = rows.select("_key", "_text", "_k", F.explode(F.when(F.col("_target").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("_to"))
    rows = rows.select("_key", "_text", "_k", F.col("_to.b").alias("_bucket"), F.col("_to.guest").alias("_guest"))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_k"), "_text")
    return rows.withColumn("_next", F.lead("_text").over(order)).where("_guest = 0").select("_bucket", "_key", "_text", "_next")


def _bucket(bounds: list[int], cells: int) -> Column:
    """Between two bounds, ``cells`` stretches of equal width; the bounds are searched by halves."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high + 1) // 2
        return F.when(F.col("_k") >= F.lit(bounds[mid]), search(mid, high)).otherwise(search(low, mid - 1))

    if not bounds:
        return F.lit(0).cast("long")
    at = search(0, len(bounds) - 1)
    lows = F.array(*[F.lit(b).cast("double") for b in bounds])
    widths = F.array(*[F.lit(float(max(1, b - a))) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)])
    cell = F.floor((F.col("_k") - F.element_at(lows, at + 1)) / F.element_at(widths, at + 1) * F.lit(cells))
    inside = F.greatest(F.lit(0), F.least(F.lit(cells - 1), cell)).cast("long")
    return F.when(F.col("_k") == -(2**63), F.lit(-1).cast("long")).otherwise(at * F.lit(cells).cast("long") + inside)


def edited(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``n_chars``, ``edited_sha256``, fingerprints of the text and of its edited form, and the likeness to that and to the next text.

    Edited: the last floor(n_chars/3) code points are replaced by the first as many (or all) of the next row's text.
    """
    rows = with_next(df, text, key)
    third = F.floor(F.length("_text") / 3).cast("int")
    rows = rows.withColumn("_edit", F.concat(F.substring("_text", F.lit(1), F.length("_text") - third), F.substring("_next", F.lit(1), third)))
    # the number only groups the three texts of a row within the task that made it
    rows = rows.select("_bucket", F.monotonically_increasing_id().alias("_row"), "_key", F.length("_text").cast("long").alias("_n"), F.sha2("_edit", 256).alias("_sha"), "_text", "_edit", "_next")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("body")) for i, c in enumerate(("_text", "_edit", "_next"))])
    by = ["_bucket", "_row", "_key", "_n", "_sha"]
    each = vectors(rows.select(*by, F.explode(kinds).alias("_of")).select(*by, "_of.kind", "_of.body"), "body", [*by, "kind"])
    vector = F.struct("n", "dense", "counts")
    wide = each.groupBy(*by).agg(*[F.max(F.when(F.col("kind") == i, vector)).alias(f"_v{i}") for i in range(3)])
    own, edit, nxt = (F.col(f"_v{i}") for i in range(3))
    return wide.select(
        F.col("_key").alias(key), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), fingerprint(own).alias("fingerprint"),
        fingerprint(edit).alias("edited_fingerprint"), likeness(own, edit).alias("near_edited"), likeness(own, nxt).alias("near_next"),
    )
