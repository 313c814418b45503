"""Exact nearest vectors from an inverted file: cells around centroids, rings within cells, and a bound that shuts out the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.ordered import with_position

#: Cells, at most; vectors of a ring; queries of a group that meets a ring; vectors the centroids are fitted on, per cell.
CELLS, RING, QUERIES, FIT = 1024, 4096, 2048, 16
#: Widens every bound a little, so that rounding shuts nothing out.
SLACK = 1e-9


def fit_centroids(vectors: DataFrame, rows: int, vector: str = "_v", seed: int = 7) -> np.ndarray:
    """Centres of about sqrt(rows) cells by k-means on a bounded sample (FIT vectors per cell, drawn by hash). Any centres give exact results."""
    cells = max(1, min(CELLS, int(rows**0.5)))
    share = min(1.0, 1.2 * FIT * cells / max(rows, 1))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select(vector).distinct()
    x = np.array([r[0] for r in drawn.limit(2 * FIT * cells).collect()], dtype=float)  # bounded by the limit
    if not len(x):
        return np.zeros((0, 0))
    x = x[np.lexsort(x.T[::-1])]
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(5):
        at = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T, 0.0))


def inverted_file(vectors: DataFrame, centres: np.ndarray, vector: str = "_v") -> tuple[DataFrame, DataFrame]:
    """The vectors with ``_cell`` (nearest centre), ``_r`` (distance to it) and ``_ring`` (RING vectors of like distance), and the table of rings.

    Rings: (_cell, _ring, inner, outer, n). Both are stored; a cell of any size is spread over its rings.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # CELLS vectors at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(np.vstack(pdf[vector].to_numpy()).astype(float), shared.value)
                at = d.argmin(axis=1)
                yield pdf.assign(_cell=at.astype(np.int64), _r=d[np.arange(len(at)), at])

    fields = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    placed = vectors.mapInPandas(place, f"{fields}, _cell long, _r double")
    stored = cut_lineage(with_position(placed, ["_r", F.xxhash64(vector)], ["_cell"]).withColumn("_ring", F.floor(F.col("_pos") / RING).cast("long")).drop("_pos"))
    rings = cut_lineage(stored.groupBy("_cell", "_ring").agg(F.min("_r").alias("inner"), F.max("_r").alias("outer"), F.count(F.lit(1)).alias("n")))
    return stored, rings


def _to_centres(queries: DataFrame, rings: DataFrame, centres: np.ndarray) -> DataFrame:
    """(_q, _limit, _cell, _d): queries with the cells whose rings may hold a vector within ``_limit`` (null: all cells), and the distance to their centres."""
    limits = rings.groupBy("_cell").agg(F.min("inner").alias("inner"), F.max("outer").alias("outer")).collect()  # CELLS rows at most
    cell = np.array([r["_cell"] for r in limits], np.int64)
    inner, outer = np.array([r["inner"] for r in limits], float), np.array([r["outer"] for r in limits], float)
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin in range(0, len(pdf), 256):
                part = pdf.iloc[begin : begin + 256]
                d = _distances(np.vstack(part["_e"].to_numpy()).astype(float), shared.value)[:, cell]
                bound = np.maximum(np.maximum(d - outer, inner - d), 0.0)
                limit = part["_limit"].to_numpy(dtype=float)
                row, at = np.nonzero((bound <= limit[:, None] * (1 + SLACK) + SLACK) | np.isnan(limit)[:, None])
                yield pd.DataFrame({"_q": part["_q"].to_numpy()[row], "_limit": limit[row], "_cell": cell[at], "_d": d[row, at]})

    return queries.mapInPandas(near, "_q long, _limit double, _cell long, _d double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, counts: dict | None = None) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (columns ``_v`` and others) to every query (``_q`` long, ``_e``): ``_q``, the other columns, ``_dist`` (Euclid).

    All queries go through one pass: each first meets the rings nearest to it until they hold k vectors, which bounds its k-th distance, and then every ring
    that the bound cannot shut out: a vector at distance r from a centre is at least abs(d - r) away from a query at distance d from it.
    Ties go by the other columns; a few more than k rows may come back, for the caller to rank. ``counts`` (if given) receives the rings ``met`` and ``possible``, summed over queries.
    """
    others = [c for c in vectors.columns if c != "_v"]
    kinds = dict(vectors.dtypes)
    schema = ", ".join(["_q long", *[f"`{c}` {kinds[c]}" for c in others], "_dist double"])
    vectors = cut_lineage(vectors)
    centres = fit_centroids(vectors, vectors.count())
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], schema)
    stored, rings = inverted_file(vectors, centres)
    asked = cut_lineage(queries.select("_q", "_e"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = np.vstack(right["_v"].to_numpy()).astype(float) if len(right) else np.zeros((0, 1))
        for begin in range(0, len(left) if len(x) else 0, 256):
            part = left.iloc[begin : begin + 256]
            e = np.vstack(part["_e"].to_numpy()).astype(float)
            d = _distances(e, x)
            cut = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else d.max(axis=1)
            row, at = np.nonzero(d <= cut[:, None] * (1 + SLACK) + SLACK)
            exact = np.sqrt(((e[row] - x[at]) ** 2).sum(axis=1))
            found = right[others].iloc[at].assign(_q=part["_q"].to_numpy()[row], _dist=exact)
            if len(found) > k * len(part):  # more than k at one distance
                found = found.sort_values(["_dist", *others]).groupby("_q", sort=False).head(k)
            out.append(found)
        columns = ["_q", *others, "_dist"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    def meet(which: DataFrame) -> DataFrame:
        """``which``: (_q, _cell, _ring); a ring meets the queries in groups."""
        group = F.pmod(F.xxhash64("_q"), F.greatest(F.lit(1), F.ceil(F.col("asks") / QUERIES)))
        sized = which.join(which.groupBy("_cell", "_ring").agg(F.count(F.lit(1)).alias("asks")), ["_cell", "_ring"]).withColumn("_g", group)
        on = ["_cell", "_ring", "_g"]
        left = sized.join(asked, "_q").select(*[F.col(c).alias(c) for c in on], "_q", "_e")
        met = sized.select(*on).distinct().select(*[F.col(c).alias(c) for c in on])
        right = stored.join(met, ["_cell", "_ring"]).select(*on, "_v", *others)
        return cut_lineage(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(compare, schema))

    bound = F.greatest(F.col("_d") - F.col("outer"), F.col("inner") - F.col("_d"), F.lit(0.0))
    everywhere = _to_centres(asked.withColumn("_limit", F.lit(None).cast("double")), rings, centres)
    # the nearest cells that hold k vectors, and of those the nearest rings
    cells = rings.groupBy("_cell").agg(F.sum("n").alias("held"))
    order = Window.partitionBy("_q").orderBy("_d", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    close = everywhere.join(cells, "_cell").withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0))).where(F.col("before") < k)
    order = Window.partitionBy("_q").orderBy("bound", "_d", "_cell", "_ring").rowsBetween(Window.unboundedPreceding, -1)
    begin = close.join(rings, "_cell").withColumn("bound", bound).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k)
    begin = cut_lineage(begin.select("_q", "_cell", "_ring"))
    first = meet(begin)
    place = F.row_number().over(Window.partitionBy("_q").orderBy("_dist"))
    limits = first.withColumn("_k", place).where(F.col("_k") == k).select("_q", F.col("_dist").alias("_limit"))
    rest = _to_centres(asked.join(limits, "_q", "left"), rings, centres).join(rings, "_cell")
    rest = rest.where(F.isnan("_limit") | F.col("_limit").isNull() | (bound <= F.col("_limit") * (1 + SLACK) + SLACK)).select("_q", "_cell", "_ring")
    rest = cut_lineage(rest.join(begin, ["_q", "_cell", "_ring"], "left_anti"))
    if counts is not None:
        counts["met"] = begin.count() + rest.count()
        counts["possible"] = asked.count() * rings.count()
    return first.unionByName(meet(rest))
