"""Exact neighbour searches in bounded groups: block against block, or grid cell against the cells around it."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_checked
from ..functions.lineage import cut_lineage
from ..functions.ordered import with_position
from .scaling import _moments


PAIR, HOME = ["_pair"], ["_pair", "_shell", "_cell"]


def _known(c: str) -> Column:
    """The value as a double, null where it is missing or NaN."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _combination(cols: Sequence[str]) -> Column:
    """Hash of the values and of which of them are null (the hash alone passes over nulls)."""
    return F.xxhash64(F.concat(*[F.when(_known(c).isNull(), "0").otherwise("1") for c in cols]), *[_known(c) for c in cols])


def _last_at_most(points: DataFrame, value: str, steps: DataFrame, start: str, name: str, below: bool = False) -> DataFrame:
    """Add to ``points`` the greatest ``_shell`` of their pair in ``steps`` that starts at most at ``value`` (``below``: under it), 0 if none does."""
    rows = points.select("*", F.col(value).alias("_v"), F.lit(0 if below else 1).alias("_k"), F.lit(None).cast("long").alias("_s"))
    marks = steps.select(*PAIR, F.col(start).alias("_v"), F.lit(1 if below else 0).alias("_k"), F.col("_shell").alias("_s"), F.lit(True).alias("_mark"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    sofar = Window.partitionBy(*PAIR).orderBy("_v", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.coalesce(F.max("_s").over(sofar), F.lit(0))).where("_mark is null").drop("_v", "_k", "_s", "_mark")


def _blocks(rows: DataFrame, block: int, wide: Column) -> DataFrame:
    """Cut each pair's rows into shells by the distance to the first pivot, and shells into cells by that to the second; a cell holds ``block`` rows at most."""
    placed = with_position(rows, ["_d1", "_id"], PAIR, "_pos", "_n")
    cells = F.when(wide, F.ceil(F.sqrt(F.ceil(F.col("_n") / block)))).otherwise(1)
    placed = placed.withColumn("_shell", F.floor(F.col("_pos") / (cells * block)).cast("long"))
    inside = F.row_number().over(Window.partitionBy(*PAIR, "_shell").orderBy("_d2", "_id")) - 1
    return cut_lineage(placed.withColumn("_cell", F.floor(inside / block).cast("long")).drop("_pos", "_n"))


def nan_euclidean_fill(df: DataFrame, columns: Sequence[str], key: str, k: int, block: int, counts: dict | None = None) -> DataFrame:
    """Mean of the ``k`` nearest donors per missing cell; ties at the same distance go to the smaller value.

    Equal rows are merged first (with their count). Rows are told apart by which columns they know: for a pair of such patterns the columns both know
    are fixed, and there the distance is Euclid's. Its triangle bound shuts out what cannot be near: donors and incomplete rows are sorted by their
    distances to two pivots (corners of the data's box) and cut into blocks. Every incomplete block is compared with the donor block it lies in, which
    gives each of its rows a k-th distance; then only with blocks whose distances to the pivots are within that. No task holds more than two blocks.
    ``counts`` (if given) receives ``compared`` and ``possible`` pairs of blocks.
    """
    cols = list(columns)
    p = len(cols)
    vals = df.select(*[_known(c).alias(c) for c in cols])
    mask = sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(cols)), F.lit(0).cast("long"))
    combos = cut_lineage(vals.groupBy(*cols).agg(F.count(F.lit(1)).alias("_w")).withColumns({"_id": _combination(cols), "_m": mask}))
    patterns = [r["_m"] for r in combos.select("_m").distinct().collect()]  # kinds of gaps that occur
    box = combos.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    pairs = []
    for a in patterns:
        for d in patterns:
            shared = [i for i in range(p) if (a & d) >> i & 1]
            if shared and d & ~a:
                near = [box[f"lo_{cols[i]}"] if i in shared else None for i in range(p)]
                far = [box[f"hi_{cols[i]}"] if i == shared[0] else v for i, v in enumerate(near)]
                pairs.append((len(pairs), a, d, len(shared) > 1, math.sqrt(p / len(shared)), near, far))
    means = {c: v[0] for c, v in _moments(df, cols, F.avg).items()}
    keyed = df.withColumn("_id", _combination(cols))
    if not pairs:
        return keyed.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) if c in cols else F.col(c) for c in df.columns])

    table = F.broadcast(df.sparkSession.createDataFrame(pairs, "_pair long, _ask long, _give long, _wide boolean, _scale double, _near array<double>, _far array<double>"))
    values = F.array(*[F.col(c) for c in cols])

    def from_pivot(pivot: str) -> Column:
        square = F.aggregate(F.zip_with(values, F.col(pivot), lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
        return F.sqrt(square)

    def side(name: str) -> DataFrame:
        of = combos.join(table, F.col("_m") == F.col(name))
        return _blocks(of.select("_pair", "_id", "_w", "_wide", "_scale", *cols, from_pivot("_near").alias("_d1"), from_pivot("_far").alias("_d2")), block, F.col("_wide"))

    asks, donors = side("_ask"), side("_give")
    limits = [F.min("_d1").alias("lo1"), F.max("_d1").alias("hi1"), F.min("_d2").alias("lo2"), F.max("_d2").alias("hi2")]
    cells = cut_lineage(donors.groupBy(*HOME).agg(*limits))
    shells = cells.groupBy(*PAIR, "_shell").agg(F.min("lo1").alias("start"))
    wants = [F.col("_shell").alias("_as"), F.col("_cell").alias("_ac")]
    ask_cells = cut_lineage(asks.groupBy(*HOME).agg(*limits).select("_pair", *wants, ((F.col("lo1") + F.col("hi1")) / 2).alias("mid1"), ((F.col("lo2") + F.col("hi2")) / 2).alias("mid2")))

    def nearest(a: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(d):
            x, y, w, scale = a[cols].to_numpy(dtype=float), d[cols].to_numpy(dtype=float), d["_w"].to_numpy(), float(a["_scale"].iloc[0])
            asked, given = ~np.isnan(x[0]), ~np.isnan(y[0])  # the same for all rows of a pair of patterns
            both = asked & given
            for row, rid, pair in zip(x, a["_id"], a["_pair"]):
                diff = y[:, both] - row[both]
                dist = np.sqrt((diff * diff).sum(axis=1)) * scale
                for j in np.nonzero(given & ~asked)[0]:
                    order = np.lexsort((y[:, j], dist))
                    before = np.concatenate([[0], np.cumsum(w[order])[:-1]])
                    for i in order[before < k]:
                        out.append((pair, rid, cols[j], float(dist[i]), float(y[i, j]), int(w[i])))
        return pd.DataFrame(out, columns=["_pair", "_id", "column", "dist", "value", "w"])

    def compare(which: DataFrame) -> DataFrame:
        """``which``: (_pair, _as, _ac, _shell, _cell), a block of asks and a block of donors."""
        on = ["_pair", "_as", "_ac", "_shell", "_cell"]
        left = asks.withColumnsRenamed({"_shell": "_as", "_cell": "_ac"}).join(which, ["_pair", "_as", "_ac"])
        right = donors.join(which, HOME)
        left, right = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))  # both come from the same rows
        return cut_lineage(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(nearest, "_pair long, _id long, column string, dist double, value double, w long"))

    # the block a block of asks lies in: its shell, then the last cell of that shell that starts before its middle
    lies = _last_at_most(ask_cells, "mid1", shells, "start", "_shell")
    home = lies.join(cells.select(*HOME, "lo2"), ["_pair", "_shell"]).withColumn("_far", F.when(F.col("lo2") <= F.col("mid2"), F.col("mid2") - F.col("lo2")).otherwise(F.lit(float("inf"))))
    home = cut_lineage(home.groupBy("_pair", "_as", "_ac", "_shell").agg(F.min_by("_cell", F.struct("_far", "_cell")).alias("_cell")))
    first = compare(home)
    sofar = Window.partitionBy("_pair", "_id", "column").orderBy("dist", "value").rowsBetween(Window.unboundedPreceding, 0)
    reached = first.withColumn("_sum", F.sum("w").over(sofar)).where(F.col("_sum") >= k).groupBy("_pair", "_id").agg(F.min("dist").alias("kth"))
    # a little more than the k-th distance, so that rounding shuts nothing out; rows without one look everywhere
    reach = F.coalesce(F.col("kth") / F.col("_scale") * (1 + 1e-9) + 1e-9 * F.greatest("_d1", "_d2"), F.lit(float("inf")))
    around = asks.join(reached, ["_pair", "_id"], "left").withColumn("_r", reach).groupBy(*HOME).agg(
        F.min(F.col("_d1") - F.col("_r")).alias("lo"), F.max(F.col("_d1") + F.col("_r")).alias("hi"), F.min(F.col("_d2") - F.col("_r")).alias("lo_2"), F.max(F.col("_d2") + F.col("_r")).alias("hi_2")
    ).select("_pair", *wants, "lo", "hi", "lo_2", "hi_2")
    span = _last_at_most(_last_at_most(around, "lo", shells, "start", "_from", below=True), "hi", shells, "start", "_to")
    span = span.withColumn("_shell", F.explode(F.sequence("_from", "_to")))
    within = (F.col("hi1") >= F.col("lo")) & (F.col("lo1") <= F.col("hi")) & (F.col("hi2") >= F.col("lo_2")) & (F.col("lo2") <= F.col("hi_2"))
    rest = span.join(cells, ["_pair", "_shell"]).where(within).select("_pair", "_as", "_ac", "_shell", "_cell")
    rest = cut_lineage(rest.join(home, ["_pair", "_as", "_ac", "_shell", "_cell"], "left_anti"))
    found = first.unionByName(compare(rest))
    if counts is not None:
        counts["compared"] = home.count() + rest.count()
        counts["possible"] = ask_cells.groupBy("_pair").count().join(cells.groupBy("_pair").agg(F.count(F.lit(1)).alias("n")), "_pair").agg(F.sum(F.col("count") * F.col("n"))).first()[0]

    # at most k entries per pair of blocks remain for every missing cell
    order = Window.partitionBy("_id", "column").orderBy("dist", "value", "w")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = found.withColumn("take", F.least(F.col("w"), F.lit(k) - before)).where("take > 0")
    fills = taken.groupBy("_id", "column").agg((F.sum(F.col("value") * F.col("take")) / F.sum("take")).alias("fill"))
    wide = fills.groupBy("_id").agg(*[F.max(F.when(F.col("column") == c, F.col("fill"))).alias(f"_f_{c}") for c in cols])
    out = join_checked(keyed, wide, ["_id"], "left")
    return out.select(
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}"), F.lit(means[c])).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


#: Distinct points of a sub-cell that are compared one by one; more are looked at a quarter of the side closer, down to this level.
LEAF, DEEPEST = 16, 24


def count_within(asks: DataFrame, points: DataFrame, dims: Sequence[str], eps: float, enough: int) -> DataFrame:
    """(dims…, n): how much weight ``_w`` of ``points`` lies within ``eps`` of each of ``asks``; counting stops once ``enough`` is reached. Asks without any are left out.

    Points lie in cells of side eps/sqrt(d). A cell's box (the span of its points) is wholly in reach, wholly out of it, or looked into: each level
    splits the undecided cells only, a quarter of the side at a time, and drops the asks that have enough. So a cell that holds half of all points is read
    along the rim of the reach of a few asks, and its points are spread over its sub-cells.
    """
    d = len(dims)
    side = eps / math.sqrt(d)
    reach = math.ceil(math.sqrt(d))
    steps = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if sum(max(abs(v) - 1, 0) ** 2 for v in o) * side * side <= eps * eps]
    low, high = [f"lo_{x}" for x in dims], [f"hi_{x}" for x in dims]

    def cell(level: int) -> Column:
        return F.array(*[F.floor(F.col(x) / side * float(4**level)).cast("long") for x in dims])

    def square(parts: list[Column]) -> Column:
        return sum((v * v for v in parts), F.lit(0.0))

    near = F.explode(F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in steps]))
    own = asks.select(*dims).distinct().select(*[F.col(x).alias(f"p_{x}") for x in dims], cell(0).alias("_home"))
    me = [f"p_{x}" for x in dims]
    front = own.withColumn("_o", near).select(*me, F.zip_with("_home", "_o", lambda a, b: a + b).alias("_in"))
    live, level, counted = points.withColumn("_in", cell(0)), 0, None
    while True:
        # boxes of the sub-cells of the cells that are still asked for
        wanted = cut_lineage(front.select("_in").distinct())
        live = cut_lineage(join_checked(live, wanted, ["_in"]).withColumn("_at", cell(level)))
        boxes = live.groupBy("_in", "_at").agg(*[F.min(x).alias(a) for x, a in zip(dims, low)], *[F.max(x).alias(b) for x, b in zip(dims, high)], F.sum("_w").alias("n"), F.count(F.lit(1)).alias("points"))
        least = square([F.greatest(F.col(a) - F.col(q), F.col(q) - F.col(b), F.lit(0.0)) for q, a, b in zip(me, low, high)])
        most = square([F.greatest(F.abs(F.col(q) - F.col(a)), F.abs(F.col(q) - F.col(b))) for q, a, b in zip(me, low, high)])
        met = cut_lineage(front.join(boxes, "_in").select(*me, "_at", "n", "points", least.alias("least"), most.alias("most")).where(F.col("least") <= eps * eps))
        inside = met.where(F.col("most") <= eps * eps).select(*me, "n")
        small = F.lit(level >= DEEPEST) | (F.col("points") <= LEAF)
        leaves = met.where((F.col("most") > eps * eps) & small).select(*me, "_at").join(live.select("_at", *dims, "_w"), "_at")
        close = leaves.where(square([F.col(q) - F.col(x) for q, x in zip(me, dims)]) <= eps * eps).select(*me, F.col("_w").alias("n"))
        found = inside.unionByName(close)
        counted = cut_lineage((found if counted is None else counted.unionByName(found)).groupBy(*me).agg(F.sum("n").alias("n")))
        front = met.where((F.col("most") > eps * eps) & ~small).select(*me, F.col("_at").alias("_in"))
        front = cut_lineage(front.join(counted.where(F.col("n") >= enough), me, "left_anti"))
        if front.isEmpty():
            return counted.withColumnsRenamed(dict(zip(me, dims)))
        live, level = live.drop("_in").withColumnRenamed("_at", "_in"), level + 1


def density_noise(points: DataFrame, dims: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """(dims…, is_outlier) of distinct ``points`` with weight ``_w``: DBSCAN noise.

    Two points of one cell are always neighbours, so all points of a cell with ``min_samples`` are core and need no comparison. Points of thinner
    cells are counted up to ``min_samples``; those that are not core then look for a single core point.
    """
    side = eps / math.sqrt(len(dims))
    cells = [f"c{i}" for i in range(len(dims))]
    placed = points.withColumns({c: F.floor(F.col(x) / side).cast("long") for c, x in zip(cells, dims)})
    sizes = placed.groupBy(*cells).agg(F.sum("_w").alias("_n"))
    placed = cut_lineage(join_checked(placed, sizes, cells).select(*dims, "_w", (F.col("_n") >= min_samples).alias("_dense")))
    thin = cut_lineage(placed.where("not _dense").select(*dims, "_w"))
    cores = cut_lineage(count_within(thin, placed.select(*dims, "_w"), dims, eps, min_samples).where(F.col("n") >= min_samples).select(*dims))
    rest = cut_lineage(thin.join(cores, list(dims), "left_anti"))
    every_core = placed.where("_dense").select(*dims).unionByName(cores).withColumn("_w", F.lit(1))
    reached = count_within(rest, every_core, dims, eps, 1).select(*dims).withColumn("_r", F.lit(False))
    calm = placed.where("_dense").select(*dims).unionByName(cores).withColumn("is_outlier", F.lit(False))
    return calm.unionByName(rest.select(*dims).join(reached, list(dims), "left").select(*dims, F.coalesce("_r", F.lit(True)).alias("is_outlier")))
