"""N-gram Jaccard join by grouped prefixes, and the components its links form.

A text is the set of its distinct word shingles. All sets are sorted in one order, rare shingles first; two sets that link must share one of the
first few (the prefix). Texts with the same prefix and size are one group. What brings groups together are neighbours in the order: two sets that link have
two common shingles with nothing between them in either, not far from the front, as every shingle of one set only can part one pair of neighbours. A pair of
rare neighbours is shared by chance far less often than a single shingle, so groups that meet are near copies, at any size of the corpus. Sizes that can link are
tied along each pair of neighbours, first inside a task, then between tasks, by intervals of sizes: a shingle pair in a third of all texts sends a few rows
per task. Texts tied together are read once, cut into blocks if they are many; there group pairs are filtered by size and by what their prefixes share, and
the members of those that are left are verified on the whole sets. Each pair meets in one task only, which counts the links of each set; what leaves the
task is one row per set, however many links there are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage
from .common import C1, WordHashes, ascii_words, mix, per_batch, sent
from .components import components

#: log2 of the places of the frequency table behind the order of shingles: PER_ROW for each text within these bounds; places of one stretch of it.
LEAST, MOST, PER_ROW, STRETCH = 20, 26, 32, 1 << 14
#: Shingles of a family's block, about; a pair of blocks is what one task holds.
BLOCK = 500_000
#: Texts whose shingles a task counts at once.
SETTLED = 512
#: Neighbours a task ties before it passes on what is left.
WAITING = 200_000
LOW = (1 << 32) - 1


class Shingles:
    """Sorted 64-bit hashes of the distinct shingles of a text: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = WordHashes()

    def of(self, text: str) -> np.ndarray:
        words = ascii_words(text)
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = self.hashes.of(words)
        k = min(self.words, n)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * C1 + h[i : n - k + 1 + i])
        return np.unique(out)


def _frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """Per hash place: four times the logarithm of how many sets have a shingle there. All texts are counted.

    The counts only order the shingles, and any one order gives the same links; a task's count of a place ends at 255.
    """
    places = 1 << min(MOST, max(LEAST, math.ceil(math.log2(PER_ROW * max(1, docs.count())))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total, waiting = Shingles(words), np.zeros(places, np.uint8), []

        def settle() -> None:
            at, n = np.unique((np.concatenate(waiting) & np.uint64(places - 1)).astype(np.int64), return_counts=True)
            total[at] = np.minimum(total[at] + n, 255)
            waiting.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                waiting.append(shingles.of(t))
                if len(waiting) == SETTLED:
                    settle()
        if waiting:
            settle()
        stretches = total.reshape(-1, STRETCH)
        for i in np.flatnonzero(stretches.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([stretches[i].tobytes()], pa.binary())], names=["at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(n, np.uint8).astype(np.int64)
        for at, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.floor(4 * np.log2(n + 1)).astype(np.uint8).tobytes()], pa.binary())], names=["at", "rank"])

    parts = docs.select("_text").mapInArrow(count, "at int, n binary")
    out = np.zeros(places, np.uint8)
    for r in parts.repartition("at").mapInArrow(add, "at int, rank binary").collect():  # one byte per place
        out[r["at"] * STRETCH : (r["at"] + 1) * STRETCH] = np.frombuffer(r["rank"], np.uint8)
    return out


def _ordered(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles, rare ones first."""
    return s[np.argsort(rank[(s & np.uint64(len(rank) - 1)).astype(np.int64)], kind="stable")]


def _prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


@functools.lru_cache(maxsize=1 << 16)
def _reach(n: int, num: int, den: int) -> int:
    """Two linked, different sets have neighbours in common within this many shingles of the one of size ``n``.

    With u shingles that only this set has and v that only the other has, at most u + v of the gaps between common shingles are spoilt. The first
    gap that is not ends within 2 u + v + 2 places: each earlier gap holds one of the u or v, and of the places before it u at most are not common.
    """
    m = np.arange(-(-num * n // den), n * den // num + 1)
    common = -(-num * (n + m) // (num + den))
    return int(np.max(2 * (n - common) + (m - common))) + 2


def _keys(ordered: np.ndarray, num: int, den: int) -> np.ndarray:
    """What linked sets have one of in common: pairs of neighbours; below a similarity of 3/4, where two sets need have none, the shingles of the prefix."""
    if num < 3 * (den - num):
        return ordered[: _prefix_size(len(ordered), num, den)]
    near = ordered[: _reach(len(ordered), num, den)]
    return mix(near[:-1] * C1 + near[1:])


def _ties(key: np.ndarray, size: np.ndarray, group: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of groups of like size that are next to each other under a key, and what is left: one interval of sizes for each run of such pairs.

    Sizes between two of a run are like one of them, so whatever falls into an interval belongs to its run. Rows: (2, pairs), then keys, (3, intervals).
    """
    at = np.lexsort((group, size, key))
    key, size, group = key[at], size[at], group[at]
    same = (key[1:] == key[:-1]) & (size[:-1] * den >= num * size[1:])
    pairs = np.stack([group[:-1][same], group[1:][same]])
    first = np.flatnonzero(np.r_[True, ~same])
    last = np.r_[first[1:], len(key)] - 1
    return pairs[:, pairs[0] != pairs[1]], key[first], np.stack([size[first], size[last], group[first]])


def link(df: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id``, the smallest key reachable by links, itself included, and ``n_links``, the number of other rows it links to.

    Two rows link if den * |intersection| >= num * |union| of their sets. A text with fewer words than a shingle is one shingle; a null or wordless
    text has none, links with nothing and is its own component. Repeated rows link; null keys never are the smallest unless all are null.
    """
    num, den = similarity
    docs = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.withColumns({"_r1": F.xxhash64("_key", "_text"), "_r2": F.xxhash64("_text")})
    context = df.sparkSession.sparkContext
    rank = context.broadcast(_frequencies(docs, words))
    rows = cut_lineage(_sets(docs, words, num, den, rank))
    classes = cut_lineage(rows.where("set is not null").groupBy("set").agg(
        F.min("_key").alias("least"), F.min(F.struct("_r1", "_r2")).alias("row"), F.first("n").alias("n"), F.first("group").alias("group"), F.count("*").alias("rows")
    ))

    # intervals of sizes under a key, in order: one that begins within reach of those before it joins them. Ties made inside a task go along as they are
    near = _neighbours(docs, words, num, den, rank)
    before = Window.partitionBy("at").orderBy("span", "group")
    end = F.when(F.col("span") >= 0, F.col("span").bitwiseAND(F.lit(LOW)))
    joins = F.max(end).over(before.rowsBetween(Window.unboundedPreceding, -1)) * den >= F.shiftright("span", 32) * num
    tie = F.col("span") < 0
    ties = near.select(F.when(tie, F.col("at")).otherwise(F.lag("group").over(before)).alias("a"), F.col("group").alias("b"), (tie | joins).alias("tied"))
    family = components(ties.where("tied and a != b").select("a", "b"))
    members = classes.join(family.withColumnRenamed("node", "group"), "group", "left").withColumn("family", F.coalesce("component", "group"))
    weights = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("weight")).where("sets > 1")
    members = members.join(weights, "family").select("family", "set", "n", "rows", "row._r1", "row._r2", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "set"), F.col("blocks")).cast("int"))

    # a family's texts, once per pair of blocks
    texts = docs.select("_r1", "_r2", "_text").join(sent(cut_lineage(members)), ["_r1", "_r2"])  # equal rows are passed over where they meet
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    texts = texts.select("family", F.explode(pair).alias("at"), "block", "set", "rows", "_text").select("family", "at.i", "at.j", "block", "set", "rows", "_text")
    links = cut_lineage(_verified(texts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "set"), words, num, den, rank))
    joined = components(links.select("a", "b"))
    linked = links.groupBy(F.col("a").alias("set")).agg(F.sum("n_links").alias("linked"))

    both = classes.select("set", "least", "rows").join(linked, "set", "left").join(joined.withColumnRenamed("node", "set"), "set", "left")
    smallest = both.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    of_set = both.join(smallest, "component", "left").select("set", F.coalesce("smallest", "least").alias("component_id"), (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = rows.select("_key", "n", "set").join(of_set, "set", "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_key").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _sets(docs: DataFrame, words: int, num: int, den: int, rank: object) -> DataFrame:
    """Per text: key, row hashes, size ``n``, ``set`` (a hash of the whole set) and ``group`` (of its prefix and size); both null without words."""

    def run(data: dict, shingles: Shingles) -> dict:
        out: dict[str, list] = {"n": [], "set": [], "group": []}
        for t in data["_text"]:
            s = shingles.of(t)
            out["n"].append(len(s))
            out["set"].append(_signed_hash(s.tobytes()) if len(s) else None)
            out["group"].append(_group(_ordered(s, rank.value), num, den) if len(s) else None)
        return {c: data[c] for c in ("_key", "_r1", "_r2")} | out

    return per_batch(docs, f"_key {dict(docs.dtypes)['_key']}, _r1 bigint, _r2 bigint, n bigint, set bigint, group bigint", run, lambda: Shingles(words))


def _group(order: np.ndarray, num: int, den: int) -> int:
    return _signed_hash(order[: _prefix_size(len(order), num, den)].tobytes() + len(order).to_bytes(8))


def _neighbours(docs: DataFrame, words: int, num: int, den: int, rank: object) -> DataFrame:
    """(at, span, group): under key ``at`` an interval of sizes (low and high in the halves of ``span``) of a group; or, with span -1, a tie of groups ``at`` and ``group``.

    What a task has tied itself leaves it as ties and one interval per run, so a key of a third of all texts sends a few rows per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, waiting, held = Shingles(words), [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(k) for k, _, _ in waiting])
            key = np.concatenate([k for k, _, _ in waiting])
            pairs, at, (low, high, group) = _ties(key, np.repeat([n for _, n, _ in waiting], sizes), np.repeat(np.array([g for _, _, g in waiting], np.int64), sizes), num, den)
            columns = np.r_[pairs[0], at.view(np.int64)], np.r_[np.full(pairs.shape[1], -1), (low << 32) | high], np.r_[pairs[1], group]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["at", "span", "group"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                s = shingles.of(t)
                if not len(s):
                    continue
                order = _ordered(s, rank.value)
                keys = _keys(order, num, den)
                if len(keys):
                    waiting.append((keys, len(s), _group(order, num, den)))
                    held += len(keys)
                if held >= WAITING:
                    yield from settle()
                    waiting, held = [], 0
        if waiting:
            yield from settle()

    return docs.select("_text").mapInArrow(run, "at bigint, span bigint, group bigint")


def _signed_hash(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _verified(texts: DataFrame, words: int, num: int, den: int, rank: object) -> DataFrame:
    """Per (family, i, j) and set with a link in it: the set ``a``, ``b`` to which it is tied, and ``n_links``; partitions are sorted, so one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, now, held = Shingles(words), None, []
        found: list[tuple[int, int, int]] = []
        for batch in batches:
            for f, i, j, block, ident, rows, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (f, i, j) != now:
                    found += connect(held, i_is_j(now), rank.value, num, den)
                    now, held = (f, i, j), []
                if not held or held[-1][0] != ident:
                    held.append((ident, block, shingles.of(text), rows))
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        found += connect(held, i_is_j(now), rank.value, num, den)
        yield _edges(found)

    def i_is_j(at: tuple | None) -> bool:
        return at is None or at[1] == at[2]

    return texts.mapInArrow(run, "a bigint, b bigint, n_links bigint")


def _edges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1, 2)], names=["a", "b", "n_links"])


def connect(held: list[tuple[int, int, np.ndarray, int]], one_block: bool, rank: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
    """For each of ``held`` (id, block, sorted set, rows) with a link: id, the first id of its component, and the rows of all sets it links to.

    Sets with one prefix and size are a group. Group pairs that share a shingle of their prefixes pass if their sizes can link and the prefixes share enough:
    what is common beyond the prefix that ends first is at most the rest of that set. Members of the pairs that pass are verified; with two
    blocks, only pairs across them are compared.
    """
    if len(held) < 2:
        return []
    held = sorted(held, key=lambda x: (len(x[2]), x[0]))
    block = np.array([h[1] for h in held])
    size = np.array([len(h[2]) for h in held])
    rows = np.array([h[3] for h in held], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    # shingles by number, so that a set is a mark per number
    _, flat = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
    flat = flat.astype(np.int32)
    mark = np.zeros(int(flat.max()) + 1, bool)

    groups: dict[tuple[int, bytes], int] = {}
    prefixes, members = [], []
    for x, (_, _, s, _) in enumerate(held):
        prefix = _ordered(s, rank)[: _prefix_size(len(s), num, den)]
        g = groups.setdefault((len(s), prefix.tobytes()), len(prefixes))
        if g == len(prefixes):
            prefixes.append(prefix)
            members.append([])
        members[g].append(x)
    length = np.array([len(p) for p in prefixes])
    n = size[[m[0] for m in members]]
    spare = n - length  # shingles beyond the prefix
    # postings: shingles in order, groups in order under each; place of each group's shingles among them
    every, owner = np.concatenate(prefixes), np.repeat(np.arange(len(prefixes), dtype=np.int32), length)
    at = np.argsort(every, kind="stable")
    new = np.r_[True, every[at][1:] != every[at][:-1]]
    begin_of = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    place = np.empty(len(at), np.int64)
    place[at] = np.arange(len(at))
    posting, starts = owner[at], np.concatenate([[0], np.cumsum(length)])

    root, links = np.arange(len(held)), np.zeros(len(held), np.int64)
    for g, own_members in enumerate(members):
        here = place[starts[g] : starts[g + 1]]
        lists = [posting[b:e] for b, e in zip(begin_of[here].tolist(), here.tolist()) if b < e]
        near = np.zeros(0, np.int64)
        if lists:
            near, shared = np.unique(np.concatenate(lists), return_counts=True)
            needed = -(-num * (n[g] + n[near]) // (num + den)) - np.maximum(spare[g], spare[near])
            near = near[(n[near] * den >= num * n[g]) & (shared >= needed)]
        others = [y for h in near.tolist() for y in members[h]]
        for k, x in enumerate(own_members):
            cand = np.array(sorted(others + own_members[:k]), np.int64)
            if not one_block and cand.size:
                cand = cand[block[cand] != block[x]]
            if not cand.size:
                continue
            own = flat[ends[x] : ends[x + 1]]
            mark[own] = True
            common = _common(flat, ends, cand, mark)
            mark[own] = False
            cand = cand[den * common >= num * (size[x] + size[cand] - common)]
            links[cand] += rows[x]
            links[x] += rows[cand].sum()
            while (cand := cand[root[cand] != root[x]]).size:
                root[root == root[cand[0]]] = root[x]
    return [(held[x][0], held[int(root[x])][0], int(links[x])) for x in np.flatnonzero(links)]


def _common(flat: np.ndarray, ends: np.ndarray, cand: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many shingles of each of ``cand`` (in order) are marked."""
    low, high = int(cand[0]), int(cand[-1]) + 1
    if high - low < 2 * len(cand):  # most of a stretch: read it whole
        return np.add.reduceat(mark[flat[ends[low] : ends[high]]], ends[low:high] - ends[low], dtype=np.int64)[cand - low]
    return np.array([np.count_nonzero(mark[flat[ends[y] : ends[y + 1]]]) for y in cand.tolist()], np.int64)
