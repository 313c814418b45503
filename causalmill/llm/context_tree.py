"""Code length of texts by context-tree weighting.

A byte is eight binary decisions; each has a tree of contexts, the preceding 0 to DEPTH bytes. Every node of a tree estimates its bit by Krichevsky-Trofimov, and a
node's block probability is half its own estimate and half the product of its children's, so all depths are mixed by how well they coded the training texts.

Texts are dealt into chunks. Each chunk gives its distinct runs of DEPTH + 1 bytes with how often its training texts have them; runs that share the last two
context bytes meet in a task, whatever their chunk. That task has all nodes below these two bytes, builds every one of them from the summed counts, scores each
distinct run once and gives the values back to the chunks, where they are summed per text. Only the nodes of depths 0 and 1, 257 contexts of 255, are sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .common import C1, SLICE, WordHashes, ascii_words, mix

DEPTH = 5
#: Words whose counts are sent to the executors, at most; the counts of the others are joined.
FREQUENT = 1 << 18
#: Bytes of text whose runs are sorted or scored at once; characters of text of a chunk, about.
PIECE, CHUNK = 2_000_000, 16_000_000
#: Bytes of texts that a task packs at once.
HELD = 32_000_000
#: Ends a text and stands before it; no byte of UTF-8.
END = 255
#: The token that ends every text, beside the hashes of its words.
END_TOKEN = 0x5BD1E995
SMOOTHING = 0.1
U8, U64 = np.uint64(8), np.uint64


def runs(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The run of DEPTH bytes before and the byte at each position of each text (words joined by a space, then END), and where each text starts."""
    joined = [b"\xff" * DEPTH + b" ".join(words) + b"\xff" for words in texts]
    data = np.frombuffer(b"".join(joined), np.uint8)
    lengths = np.array([len(j) for j in joined])
    code = np.zeros(len(data), np.uint64)
    code[:DEPTH] = 0
    for back in range(DEPTH + 1):  # the byte itself is the lowest
        code[back:] |= data[: len(data) - back].astype(np.uint64) << U64(8 * back)
    keep = np.ones(len(data), bool)
    begins = np.cumsum(lengths) - lengths
    for i in range(DEPTH):
        keep[begins + i] = False
    return code[keep], np.cumsum(lengths - DEPTH) - (lengths - DEPTH)


def _pieces(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for words in texts:
        held.append(words)
        size += sum(map(len, words)) + len(words)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _add(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(np.concatenate([known[0], keys]), np.concatenate([known[1], counts]))


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[first], *[np.add.reduceat(v[order], first) for v in values])


def gather(docs: DataFrame) -> DataFrame:
    """Counts of the words (by hash) of all texts of ``docs`` (``_text``): rows ``key``, ``n``; added up per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, nothing = WordHashes(), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        total, waiting = nothing, []

        def settle() -> None:
            nonlocal total
            if waiting:
                total = _add(total, np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
                waiting.clear()

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal total
            settle()
            keys, counts = total
            for at in range(0, len(keys), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=["key", "n"])
            total = nothing

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = [ascii_words(t) for t in batch.column(0).slice(at, 1024).to_pylist()]
                for piece in _pieces(texts):
                    words = np.concatenate([hashes.of(w) for w in piece])
                    waiting.append(np.unique(np.append(words, np.full(len(piece), END_TOKEN, np.uint64)), return_counts=True))
                if sum(len(w[0]) for w in waiting) > 2_000_000:
                    settle()
                if len(total[0]) > 4_000_000:  # a bound on what a task holds; the sums are made after the shuffle anyway
                    yield from emit()
        yield from emit()

    rows = docs.select("_text").mapInArrow(count, "key bigint, n bigint")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log of gamma(n + 1/2) / gamma(1/2), or of n!."""
    z = n + (0.5 if half else 1.0)
    shift = np.zeros_like(z)
    while (low := z < 8).any():
        shift[low] += np.log(z[low])
        z = np.where(low, z + 1, z)
    value = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift
    return value - (0.5 * math.log(math.pi) if half else 0.0)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones in any fixed order."""
    return _log_gamma(zeros.astype(float), True) + _log_gamma(ones.astype(float), True) - _log_gamma((zeros + ones).astype(float), False)


def _weight(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Of a node's own estimate against the product of its children's."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _bits(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the deepest contexts: each run gives eight, one per bit of its last byte."""
    context, byte = key >> U8, (key & U64(255)).astype(np.int64)
    nodes = [(context << U8) | ((1 << j) | (byte >> (8 - j))).astype(np.uint64) for j in range(8)]
    ones = [n * ((byte >> (7 - j)) & 1) for j in range(8)]
    return _sums(np.concatenate(nodes), np.tile(n, 8) - np.concatenate(ones), np.concatenate(ones))


def _shorten(key: np.ndarray, depth: int) -> np.ndarray:
    """The node whose context lacks the oldest of ``depth`` + 1 bytes."""
    return (((key >> U8) & U64((1 << (8 * depth)) - 1)) << U8) | (key & U64(255))


#: Of one depth: nodes (context << 8 | bits so far) in order, P(1), weight of the own estimate.
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def _nodes(key: np.ndarray, n: np.ndarray) -> tuple[list[Level], tuple[np.ndarray, ...]]:
    """All nodes of depths DEPTH to 2 over counted runs, deepest first, and what depth 1 gets from them: node, zeros, ones, log of the product of the children."""
    key, zeros, ones = _bits(key, n)
    own = block = estimate(zeros, ones)
    weight, levels = np.ones(len(key)), []
    for depth in range(DEPTH, 1, -1):
        levels.append((key, (ones + 0.5) / (zeros + ones + 1), weight))
        key, zeros, ones, below = _sums(_shorten(key, depth - 1), zeros, ones, block)
        own = estimate(zeros, ones)
        block, weight = np.logaddexp(own, below) - math.log(2), _weight(own, below)
    return levels, (key, zeros, ones, below)


def _top(stored: DataFrame) -> list[Level]:
    """The nodes of depths 1 and 0; at most 256 contexts of 255 nodes whatever the texts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, _ = _counted(list(batches))
        if n.any():
            key, zeros, ones, below = _nodes(key[n > 0], n[n > 0])[1]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(below)], names=["key", "zeros", "ones", "below"])

    rows = stored.mapInArrow(parts, "key bigint, zeros bigint, ones bigint, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).collect()
    kinds = {"key": np.uint64, "zeros": np.int64, "ones": np.int64, "below": np.float64}
    key, zeros, ones, below = (np.array([r[c] for r in rows], k) for c, k in kinds.items())
    order, levels = np.argsort(key), []
    key, zeros, ones, below = key[order], zeros[order], ones[order], below[order]
    for depth in (1, 0):
        own = estimate(zeros, ones)
        levels.append((key, (ones + 0.5) / (zeros + ones + 1), _weight(own, below)))
        if depth:
            key, zeros, ones, below = _sums(_shorten(key, 0), zeros, ones, np.logaddexp(own, below) - math.log(2))
    return levels


def _log_probability(key: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probabilities of runs under the nodes of all depths, deepest first."""
    context, byte = key >> U8, (key & U64(255)).astype(np.int64)
    total = np.zeros(len(key))
    for j in range(8):
        node = ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
        bit = (byte >> (7 - j)) & 1
        p, any_below = np.full(len(key), 0.5), np.zeros(len(key), bool)
        for depth, (nodes, one, weights) in zip(range(DEPTH, -1, -1), levels, strict=True):
            if not len(nodes):
                continue
            wanted = ((context & U64((1 << (8 * depth)) - 1)) << U8) | node
            at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
            held, own, weight = nodes[at] == wanted, one[at], weights[at]
            p = np.where(held, np.where(any_below, weight * own + (1 - weight) * p, own), p)
            any_below |= held
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def _counted(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Distinct runs of a task in order, how often training has them, and the runs of each block with its chunk."""
    blocks = [(c, _keys(k), _loose(n, "<i8")) for b in batches for c, k, n in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    key, n = _sums(np.concatenate([b[1] for b in blocks]), np.concatenate([b[2] for b in blocks]))
    return key, n, [b[:2] for b in blocks]


def _squeezed(values: np.ndarray) -> bytes:
    """An array of eight-byte numbers as compressed bytes, all first bytes first."""
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), 8).T), "zstd", asbytes=True)


def _loose(blob: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    data = pa.decompress(blob[8:], 8 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).reshape(-1).view(kind)


def _steps(keys: np.ndarray) -> bytes:
    """Keys in order as the compressed steps between them."""
    return _squeezed(np.diff(keys, prepend=U64(0)))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_loose(blob, "<u8"), dtype=np.uint64)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` as compressed Arrow streams of the rows of a chunk: ``_chunk``, ``packed``, so that texts are shuffled in fewer bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(np.argsort(table.column("_chunk").to_numpy(), kind="stable")))
            chunk = table.column("_chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:]):
                out = pa.BufferOutputStream()
                part = table.slice(a, b - a).drop_columns("_chunk")
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk[a])], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["_chunk", "packed"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > HELD:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    return rows.mapInArrow(pack, "_chunk bigint, packed binary")


def _unpacked(blob: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a stream of ``_packed``, in slices."""
    for batch in pa.ipc.open_stream(blob):
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket of the last two context bytes: the distinct runs of all texts, and how often those with ``_train`` have each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        total, waiting, size, now = nothing, [], 0, None

        def settle() -> None:
            nonlocal total, size
            if waiting:
                total = _add(total, np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
                waiting.clear()
                size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal total
            settle()
            key, n = total
            total = nothing
            if not len(key):
                return
            bucket = (mix((key >> U8 & U64(0xFFFF)) * C1) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, n, bucket = key[order], n[order], bucket[order]
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            spans = list(zip(cuts, cuts[1:]))
            columns = [[int(bucket[a]) for a, _ in spans], [now] * len(spans), [_steps(key[a:b]) for a, b in spans], [_squeezed(n[a:b]) for a, b in spans]]
            for at in range(0, len(spans), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + 256], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "keys", "n"]
                )

        for chunk, blob in ((c.as_py(), b.as_py()) for batch in batches for c, b in zip(*batch.columns, strict=True)):
            if chunk != now:
                yield from emit()
                now = chunk
            for part in _unpacked(blob):
                train = part.column(0).to_numpy(zero_copy_only=False)
                texts = [ascii_words(t) for t in part.column(1).to_pylist()]
                for learnt in (True, False):
                    for piece in _pieces([t for t, k in zip(texts, train, strict=True) if bool(k) == learnt]):
                        key, n = np.unique(runs(piece)[0], return_counts=True)
                        waiting.append((key, n if learnt else np.zeros(len(n), np.int64)))
                        size += len(key)
                if size > 1_000_000:
                    settle()
        yield from emit()

    placed = _packed(docs.select("_chunk", "_train", "_text")).repartition("_chunk").sortWithinPartitions("_chunk")
    return placed.mapInArrow(count, "bucket bigint, chunk bigint, keys binary, n binary")


def _values(stored: DataFrame, top: object) -> DataFrame:
    """Per block its runs with their log10 probabilities: ``chunk``, ``keys``, ``values``."""

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, blocks = _counted(list(batches))
        if not blocks:
            return
        found = _log_probability(key, _nodes(key[n > 0], n[n > 0])[0] + top.value).astype("<f4")
        for at in range(0, len(blocks), 64):
            part = blocks[at : at + 64]
            yield pa.RecordBatch.from_arrays([
                pa.array([c for c, _ in part], pa.int64()), pa.array([_steps(k) for _, k in part], pa.binary()), pa.array([found[np.searchsorted(key, k)].tobytes() for _, k in part], pa.binary()),
            ], names=["chunk", "keys", "values"])

    return stored.mapInArrow(value, "chunk bigint, keys binary, values binary")


class Scorer:
    """Sums over the texts of a chunk, whose runs and their log10 probabilities it is given; a run is looked up by hash, or by search if another has its place."""

    def __init__(self, parts: list[tuple[bytes, bytes]]):
        key, value = np.concatenate([_keys(k) for k, _ in parts]), np.concatenate([np.frombuffer(v, "<f4") for _, v in parts])
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        places = 1 << max(10, math.ceil(math.log2(2 * len(key))))
        self.mask = U64(places - 1)
        self.at = np.zeros(places, np.int64)
        self.at[(mix(self.key * C1) & self.mask).astype(np.int64)] = np.arange(len(key))

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        key, starts = runs(texts)
        at = self.at[(mix(key * C1) & self.mask).astype(np.int64)]
        other = np.flatnonzero(self.key[at] != key)
        at[other] = np.searchsorted(self.key, key[other])
        return np.add.reduceat(self.value[at].astype(float), starts)


def score(df: DataFrame, train: object, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (words alone, with added 0.1) and ``score`` (log10).

    ``train``: condition on ``_key`` for rows to learn from. Texts are their words (A-Z lower-cased) with one space between and an end; a null text is
    the end alone. Nothing to learn from: every bit costs one bit, and the base has no counts. Repeated rows are learnt as often as they occur.
    """
    docs = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = cut_lineage(gather(docs.where(train)))
    size = docs.agg(F.coalesce(F.sum(F.length("_text") + 1), F.lit(0))).first()[0]
    # the chunk of a row is a hash of it, so a task that runs again finds the same
    docs = docs.withColumns({"_train": F.coalesce(F.expr(train) if isinstance(train, str) else train, F.lit(False)), "_chunk": F.pmod(F.xxhash64("_key", "_text"), F.lit(size // CHUNK + 1))})
    stored = cut_lineage(_blocks(docs, min(1 << 16, 64 + size // (CHUNK // 4))).repartition("bucket").select("chunk", "keys", "n"))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, log_all = sums["n"], math.log10(sums["n"] + SMOOTHING * (sums["v"] + 1))
    # the least count from which words are few enough to be sent
    least, seen = 1 << 62, 0
    for r in words.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        seen += r["words"]
        if seen > FREQUENT:
            break
        least = r["least"]
    often = words.where(F.col("n") >= least).collect()  # at most FREQUENT
    known = np.array([r["key"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(known)
    context = df.sparkSession.sparkContext
    sent = context.broadcast((known[order], np.array([r["n"] for r in often], np.int64)[order]))
    values = _values(stored, context.broadcast(_top(stored)))

    def measure(data: list[str], scorer: Scorer, hashes: WordHashes) -> dict:
        frequent, counted = sent.value
        texts = [ascii_words(t) for t in data]
        out: dict[str, list] = {"n_tokens": [len(w) + 1 for w in texts], "score": [], "n_known": [], "base": [], "rare": [], "times": []}
        for piece in _pieces(texts):
            out["score"].extend(scorer.of(piece).tolist())
        for words in texts:
            tokens, times = np.unique(np.append(hashes.of(words), U64(END_TOKEN)), return_counts=True)
            at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
            hit = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
            out["n_known"].append(int(times[hit].sum()))
            out["base"].append(float((times[hit] * np.log10(counted[at[hit]] + SMOOTHING)).sum()))
            out["rare"].append(tokens[~hit].view(np.int64))
            out["times"].append(times[~hit])
        return out

    columns = {"n_tokens": pa.int64(), "score": pa.float64(), "n_known": pa.int64(), "base": pa.float64(), "rare": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, parts, scorer = WordHashes(), None, [], None
        for chunk, is_text, *given in (tuple(v.as_py() for v in row) for batch in batches for row in zip(*batch.columns, strict=True)):
            if chunk != now:
                now, parts, scorer = chunk, [], None
            if not is_text:  # the values of a chunk stand before its texts
                parts.append((given[1], given[2]))
                continue
            if scorer is None:
                scorer, parts = Scorer(parts), []
            for some in _unpacked(given[0]):
                out = measure(some.column(1).to_pylist(), scorer, hashes)
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(out[c], t) for c, t in columns.items()]], names=["_key", *columns])

    kind = dict(df.dtypes)[key]
    schema = f"_key {kind}, n_tokens bigint, score double, n_known bigint, base double, rare array<bigint>, times array<int>"
    none = F.lit(None).cast("binary")
    texts = _packed(docs.select("_chunk", "_key", "_text")).select("_chunk", F.lit(True).alias("_is_text"), "packed", none.alias("keys"), none.alias("values"))
    values = values.select(F.col("chunk").alias("_chunk"), F.lit(False).alias("_is_text"), none.alias("packed"), "keys", "values")
    rows = cut_lineage(texts.union(values).repartition("_chunk").sortWithinPartitions("_chunk", "_is_text").mapInArrow(run, schema))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # over the stored copy, so always the same
    rare = rows.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("_t")).select("_row", F.col("_t.rare").alias("key"), F.col("_t.times").alias("times"))
    # the words that are not sent: each is rarer than the sent ones, so no key is hot
    rare = rare.join(words.where(F.col("n") < least), "key", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("_base")
    )
    out = rows.drop("rare", "times").join(rare, "_row", "left")
    return out.select(
        F.col("_key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all if total else 0.0)).alias("base_score"), "score",
    )
