"""Ranked search over segments of an inverted index, with bounds for single terms and for pairs of terms.

Texts are read once into segments: bounded sets of documents with the postings of the terms that the queries use, stored as one row each. Counts of
documents per term come from the segments. A second table then stores, per segment, the impacts of every term, their maximum, and for the pairs that
the queries ask for the list of documents that hold both, with joint impacts and the joint maximum. A query walks the segments of a task and keeps its
k best: what two paired terms can add is bounded by the greatest of their joint maximum and their single maxima, which is less than the sum of the
maxima wherever the terms meet rarely. Units of least bound are only looked up for documents that others have already brought near the k-th score.
The best of each task are merged by score. Every number is an integer, so skipping changes no result.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage

#: A segment ends with the document that reaches one of these.
SEGMENT_ROWS, SEGMENT_POSTINGS = 4096, 1_000_000
#: Items searched in one pass over the index, and the bytes of text they may hold together; more items take more passes.
ITEM_ROWS, ITEM_BYTES = 1024, 1 << 24
K1_SCALE, B_PERCENT = 8, 90
IMPACT = 1_000_000_000

#: A-Z become a-z; ASCII that is no letter or digit becomes a space; all other bytes stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


class Plan(NamedTuple):
    """The queries of one pass: term numbers per item (heaviest first), and the pairs of neighbours in that order."""

    queries: list[np.ndarray]
    pairs: np.ndarray  # (number of pairs, 2), every pair once


SEGMENT = "rows long, docs binary, sizes binary, terms binary, starts binary, postings binary, tfs binary, nulls binary"
INDEX = "docs binary, nulls binary, terms binary, starts binary, postings binary, impacts binary, maxima binary, pair_starts binary, pair_postings binary, pair_impacts binary, pair_maxima binary"


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _rows(rows: list[list], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def segments(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Postings of the terms in ``vocabulary``, one row per segment: keys, sizes in terms, and (document, frequency) lists by term number.

    Null and wordless texts take part in no segment. ``rows`` counts the documents; a very long text closes its segment. Keys are whole numbers or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [c.split()[0] for c in SEGMENT.split(", ")], [pa.int64()] + [pa.binary()] * 7
        keys, sizes, term_parts, doc_parts, tf_parts, held = [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            term, doc, tf = (np.concatenate(p) if p else np.zeros(0, np.int32) for p in (term_parts, doc_parts, tf_parts))
            order = np.lexsort((doc, term))
            term, doc, tf = term[order], doc[order], tf[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            null = np.array([k is None for k in keys], np.bool_)
            row = [len(keys), *_bytes(np.array([k or 0 for k in keys], np.int64), np.array(sizes, np.int64), term[starts], np.r_[starts, len(term)].astype(np.int32), doc, tf, null)]
            return _rows([row], names, kinds)

        for batch in batches:
            column = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                found = terms(column[i].as_py())
                if not found:
                    continue
                known = Counter(map(vocabulary.get, found))
                known.pop(None, None)
                n = len(known)
                term_parts.append(np.fromiter(known.keys(), np.int32, n))
                tf_parts.append(np.fromiter(known.values(), np.int32, n))
                doc_parts.append(np.full(n, len(keys), np.int32))
                keys.append(doc_id)
                sizes.append(len(found))
                held += n
                if len(keys) >= SEGMENT_ROWS or held >= SEGMENT_POSTINGS:
                    yield close()
                    keys, sizes, term_parts, doc_parts, tf_parts, held = [], [], [], [], [], 0
        if keys:
            yield close()

    return docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text")).mapInArrow(run, SEGMENT)


def statistics(stored: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the documents that hold each of the ``size`` terms, over all segments; a task sends at most one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                at, starts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["starts"], np.int32)
                df[at] += np.diff(starts)
                rows += row["rows"]
                total += int(np.frombuffer(row["sizes"], np.int64).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at], pa.int64()), pa.array(np.r_[rows, total, df[at]], pa.int64())], names=["term", "n"])

    counted = {r["term"]: r["n"] for r in stored.select("rows", "sizes", "terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(size, np.int64)
    for term, n in counted.items():
        if term >= 0:
            df[term] = n
    return counted.get(-2, 0), counted.get(-1, 0), df


def weights(rows: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) for every term."""
    return np.floor(1000.0 * np.log((2.0 * rows + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def plan(items: list[list[int]], weight: np.ndarray) -> Plan:
    """Terms that can add to a score, heaviest first; each is paired with its two neighbours in that order, so that either matching can be used."""
    queries = [np.array(sorted({t for t in item if weight[t] > 0}, key=lambda t: (-weight[t], t)), np.int32) for item in items]
    pairs = sorted({tuple(sorted(p)) for q in queries for p in zip(q[:-1].tolist(), q[1:].tolist())})
    return Plan(queries, np.array(pairs, np.int32).reshape(-1, 2))


def index(stored: DataFrame, rows: int, total: int, weight: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Segments with impacts: maxima and lists of every term, and of every pair the documents that hold both, with the sum of both impacts."""
    partner = {int(a): pairs[pairs[:, 0] == a, 1] for a in np.unique(pairs[:, 0])} if len(pairs) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                at, starts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["starts"], np.int32).astype(np.int64)
                doc, tf = np.frombuffer(row["postings"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
                m = 100 - B_PERCENT + (B_PERCENT * np.frombuffer(row["sizes"], np.int64) * rows) // total
                impact = np.repeat(weight[at], np.diff(starts)) * ((IMPACT * tf) // (1000 * tf + K1_SCALE * m[doc]))
                maxima = np.maximum.reduceat(impact, starts[:-1]) if len(at) else np.zeros(0, np.int64)
                place = {int(t): i for i, t in enumerate(at)}
                scratch = np.full(row["rows"], -1, np.int64)
                docs_of, joint, counts, tops = [], [], [], []
                for a, others in partner.items():  # pairs come in the order of this walk: by first term, then by second
                    i = place.get(a)
                    if i is not None:
                        scratch[doc[starts[i] : starts[i + 1]]] = impact[starts[i] : starts[i + 1]]
                    for b in others.tolist():
                        j = place.get(b)
                        n = top = 0
                        if i is not None and j is not None:
                            d = doc[starts[j] : starts[j + 1]]
                            first = scratch[d]
                            both = first >= 0
                            n = int(np.count_nonzero(both))
                            if n:
                                sums = first[both] + impact[starts[j] : starts[j + 1]][both]
                                docs_of.append(d[both])
                                joint.append(sums)
                                top = int(sums.max())
                        counts.append(n)
                        tops.append(top)
                    if i is not None:
                        scratch[doc[starts[i] : starts[i + 1]]] = -1
                pair_docs = np.concatenate(docs_of) if docs_of else np.zeros(0, np.int32)
                pair_sums = np.concatenate(joint) if joint else np.zeros(0, np.int64)
                out = [row["docs"], row["nulls"], row["terms"], row["starts"], row["postings"]]
                out += _bytes(impact, maxima, np.cumsum([0, *counts]).astype(np.int64), pair_docs, pair_sums, np.array(tops, np.int64))
                yield _rows([out], names, [pa.binary()] * len(names))

    return stored.mapInArrow(run, INDEX)


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict) -> None:
        part = lambda name, kind: np.frombuffer(row[name], kind)
        self.docs, self.null = part("docs", np.int64), part("nulls", np.bool_)
        self.starts, self.postings, self.impacts, self.maxima = part("starts", np.int32), part("postings", np.int32), part("impacts", np.int64), part("maxima", np.int64)
        self.place = {t: i for i, t in enumerate(part("terms", np.int32).tolist())}
        self.pair_starts, self.pair_postings = part("pair_starts", np.int64), part("pair_postings", np.int32)
        self.pair_impacts, self.pair_maxima = part("pair_impacts", np.int64), part("pair_maxima", np.int64)

    def term(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.postings[a:b], self.impacts[a:b]

    def pair(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.pair_starts[p], self.pair_starts[p + 1]
        return self.pair_postings[a:b], self.pair_impacts[a:b]


class Best:
    """The k best rows of one query so far: score descending, key ascending, null keys last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.keys, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_)

    @property
    def least(self) -> int:
        """No row below this score can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, keys: np.ndarray, null: np.ndarray) -> None:
        s, d, z = np.r_[self.scores, scores], np.r_[self.keys, keys], np.r_[self.null, null]
        at = np.lexsort((d, z, -s))[: self.k]
        self.scores, self.keys, self.null = s[at], d[at], z[at]


class Unit(NamedTuple):
    bound: int
    first: int
    second: int | None
    pair: int | None


def units(seg: Segment, query: np.ndarray, number: dict[tuple[int, int], int]) -> tuple[list[Unit], int]:
    """The matching with the lower bound of the two (pairs from the first term on, or from the second), and that bound.

    A term that the segment lacks leaves its partner alone. What a pair adds to one document is at most the joint maximum if it holds both terms, and at
    most the greater single maximum if it holds one.
    """
    best: tuple[int, list[Unit]] | None = None
    for begin in (0, 1):
        cut = ([query[:1]] if begin else []) + [query[i : i + 2] for i in range(begin, len(query), 2)]
        found, total = [], 0
        for group in cut:
            known = [(int(t), seg.place[int(t)]) for t in group if int(t) in seg.place]
            if not known:
                continue
            tops = [int(seg.maxima[i]) for _, i in known]
            if len(known) == 2:
                p = number[tuple(sorted(t for t, _ in known))]
                unit = Unit(max(int(seg.pair_maxima[p]), *tops), known[0][1], known[1][1], p)
            else:
                unit = Unit(tops[0], known[0][1], None, None)
            found.append(unit)
            total += unit.bound
        if best is None or total < best[0]:
            best = (total, found)
        if len(query) < 3:
            break
    return best[1], best[0]


def look_up(docs: np.ndarray, impacts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The impacts of ``wanted`` (ascending) in a list, 0 where it has none."""
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, impacts[at], 0)


def search_segment(seg: Segment, query: np.ndarray, number: dict[tuple[int, int], int], best: Best, seen: Counter | None = None) -> None:
    """Let ``best`` take what ``seg`` has to offer for ``query``. ``seen`` counts segments skipped, and postings read of those there are."""
    found, bound = units(seg, query, number) if len(query) else ([], 0)
    if seen is not None:
        seen["segments"] += 1
        seen["skipped"] += bound < best.least
        seen["postings"] += sum(len(seg.term(i)[0]) for u in found for i in (u.first, u.second) if i is not None)
    if not found or bound < best.least:
        return
    found.sort(key=lambda u: -u.bound)
    below = np.cumsum([u.bound for u in found][::-1])[::-1]  # what unit i and all later ones can add at most
    needed = int(np.searchsorted(-below, -best.least, side="right"))  # a document in none of the first ``needed`` units stays below
    scores = np.zeros(len(seg.docs), np.int64)
    for u in found[:needed]:
        for i in (u.first, u.second):
            if i is not None:
                docs, impacts = seg.term(i)
                scores[docs] += impacts
                if seen is not None:
                    seen["read"] += len(docs)
    wanted = np.flatnonzero(scores)
    scores = scores[wanted]
    for u, rest in zip(found[needed:], below[needed:]):
        near = scores + rest >= best.least
        wanted, scores = wanted[near], scores[near]
        if not len(wanted):
            return
        if seen is not None:
            seen["looked up"] += len(wanted) * (2 if u.second is not None else 1)
        if u.second is None:
            scores = scores + look_up(*seg.term(u.first), wanted)
            continue
        joint = look_up(*seg.pair(u.pair), wanted) if seg.pair_starts[u.pair + 1] > seg.pair_starts[u.pair] else np.zeros(len(wanted), np.int64)
        alone = np.maximum(look_up(*seg.term(u.first), wanted), look_up(*seg.term(u.second), wanted))  # both only where ``joint`` is greater
        scores = scores + np.maximum(joint, alone)
    keep = scores >= best.least
    wanted, scores = wanted[keep], scores[keep]
    if len(wanted) > best.k:  # equal scores stay together
        cut = np.partition(scores, -best.k)[-best.k]
        wanted, scores = wanted[scores >= cut], scores[scores >= cut]
    best.add(scores, seg.docs[wanted], seg.null[wanted])


def search(indexed: DataFrame, queries: Plan, k: int) -> DataFrame:
    """(``query``, ``key``, ``score``): the k best rows of every task for every query, all with scores above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {(a, b): p for p, (a, b) in enumerate(queries.pairs.tolist())}
        best = [Best(k) for _ in queries.queries]
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                for query, b in zip(queries.queries, best):
                    search_segment(seg, query, number, b)
        at = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        of = lambda name: np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(of("keys"), pa.int64(), mask=of("null").astype(bool)), pa.array(of("scores"), pa.int64())], names=["query", "key", "score"])

    return indexed.mapInArrow(run, "query long, key long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k rows of ``docs`` that score highest for each row of ``items``, scores above 0 only: item key, ``rank`` (from 1), key, ``score``.

    Null and wordless texts and items find nothing. Equal scores go by ascending key, null keys last. Repeated rows of ``docs`` are ranked one by one,
    repeated rows of ``items`` are answered one by one; item keys may be null. Items are taken in blocks bounded in rows and bytes, each with an index of its own
    terms over all of ``docs``.
    """
    kind = items.schema[item_key].dataType.simpleString()
    asked = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("words"))
    numbered = cut_lineage(asked.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.coalesce(F.octet_length("words"), F.lit(0)).cast("long")))
    out = None
    for block in _blocks(numbered):
        vocabulary: dict[bytes, int] = {}
        queries = [[vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(terms(r["words"]))] for r in block]
        stored = cut_lineage(segments(docs, vocabulary, text, key))
        rows, total, df = statistics(stored, len(vocabulary))
        weight = weights(rows, df)
        todo = plan(queries, weight)
        indexed = cut_lineage(index(stored, rows, total, weight, todo.pairs))
        found = search(indexed, todo, k)
        place = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = items.sparkSession.createDataFrame([(q, r["item"]) for q, r in enumerate(block)], f"query long, item {kind}")  # a bounded block
        found = found.join(F.broadcast(names), "query").select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.select(F.col(f"`{item_key}`"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(key), F.lit(0).cast("long").alias("score")).limit(0)
    return out


def _blocks(numbered: DataFrame) -> Iterator[list]:
    """Rows of ``numbered`` in blocks of at most ITEM_ROWS rows and ITEM_BYTES bytes; an item longer than that is a block of its own."""
    rows, held = [], 0
    for r in numbered.orderBy("row").toLocalIterator():  # one partition of the queries at a time
        if rows and (len(rows) >= ITEM_ROWS or held + r["size"] > ITEM_BYTES):
            yield rows
            rows, held = [], 0
        rows.append(r)
        held += r["size"]
    if rows:
        yield rows
