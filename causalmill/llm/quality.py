"""Quality by votes of nearest neighbours among labelled latent-semantic vectors.

A text's terms are its words and its runs of four bytes, both hashed, over the whole text; the shapes of its bytes (triples of character classes) and marks of
repetition are added with half the weight. Their TF-IDF vectors are reduced by a truncated singular value decomposition fitted on a bounded sample of labelled rows;
the sample's vectors are sent to the executors (at most 2 * PER_CLASS of them), where every text is compared with all of them in blocks. Its nearest vote
with their cosine as weight. The cosine is that of the whole text: what its words have outside the latent space counts as unlike, so a text of unknown
words has little weight behind its votes and its score stays near one half.
"""

from __future__ import annotations

from collections.abc import Sequence
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fold, keep_rows, mix, per_batch
from .sampling import sample

#: Labelled rows fitted on, per label; dimensions kept; rounds of fitting them; neighbours that vote; power of the similarity.
PER_CLASS, DIMENSIONS, ROUNDS, NEIGHBOURS, POWER = 2_500, 64, 8, 15, 4.0
#: Weight of the votes of nobody, which go half to each label.
DOUBT = 0.05
CLASSES = 16
SHAPES = CLASSES**3 + 4
#: Hash places of words and of runs of bytes; begins of the three kinds of terms, and the weight of each kind.
PLACES = 1 << 13
KINDS, WEIGHTS = (0, PLACES, 2 * PLACES), (1.0, 1.0, 0.5)
TERMS = 2 * PLACES + SHAPES
#: Texts whose dense vectors are held at once.
HELD = 64


def _classes() -> np.ndarray:
    kind = np.full(256, 15, np.int32)  # beyond ASCII
    kind[:128] = 14
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",", ";:?", "!", "\"'()-_", "%", "$&#@^~", "*+=", "|", "<>/\\[]{}`")):
        kind[[ord(c) for c in chars]] = i
    return kind


KIND = _classes()
TOP = np.uint64(64 - PLACES.bit_length() + 1)  # the highest bits of a hash are its place


def term_counts(text: str, hashes: WordHashes) -> np.ndarray:
    """Counts of the terms of a text: words, runs of four bytes (lower case), shapes."""
    out = np.zeros(TERMS, np.float32)
    low = text.lower().encode()
    words, code = low.split(), np.frombuffer(low, np.uint8).astype(np.uint64)
    if words:
        out[:PLACES] = np.bincount((hashes.of(words) >> TOP).astype(np.int64), minlength=PLACES)
    if len(code) > 3:
        runs = (code[:-3] << np.uint64(24)) | (code[1:-2] << np.uint64(16)) | (code[2:-1] << np.uint64(8)) | code[3:]
        out[PLACES : 2 * PLACES] = np.bincount((mix(runs) >> TOP).astype(np.int64), minlength=PLACES)
    out[2 * PLACES :] = shape_counts(text)
    return out


def shape_counts(text: str) -> np.ndarray:
    """Counts of class triples, then distinct words, all words, words like the one before, repeated word pairs."""
    out = np.zeros(SHAPES, np.float32)
    c = KIND[np.frombuffer(text.encode(), np.uint8)]
    if len(c) > 2:
        out[: CLASSES**3] = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    words = text.split()
    if words:
        following = words[1:]
        out[-4:] = len(set(words)), len(words), sum(map(eq, words, following)), len(following) - len(set(zip(words, following, strict=False)))
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of the share of each term among those of its kind, so that length does not count."""
    out = np.array(counts, np.float32)
    for a, b in ((0, PLACES), (PLACES, 2 * PLACES), (2 * PLACES, 2 * PLACES + CLASSES**3)):
        out[:, a:b] /= np.maximum(out[:, a:b].sum(axis=1, keepdims=True), 1)
    out[:, -4:] /= np.maximum(counts[:, -3:-2], 1)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Votes:
    """Fitted model: weights of terms, axes, the labelled vectors, their labels and class weights."""

    def __init__(self, counts: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, population: dict[int, int]):
        """``counts``: the terms that each labelled text has, and how often."""
        present = np.zeros(TERMS, np.int64)
        for at, _ in counts:
            present[at] += 1
        self.idf = (np.log((1 + len(counts)) / (1 + present)) + 1).astype(np.float32)

        # the sample's vectors, of which most places are 0
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for at, n in counts:
            dense = np.zeros((1, TERMS), np.float32)
            dense[0, at] = n
            rows.append((at, self.weighted(dense)[0, at]))
        # leading right singular vectors by subspace iteration from a fixed start
        k = min(DIMENSIONS, len(rows))
        q = np.random.default_rng(7).standard_normal((TERMS, k)).astype(np.float32)
        for _ in range(ROUNDS if k else 0):
            out = np.zeros_like(q)
            for at, x in rows:
                out[at] += x[:, None] * (x @ q[at])
            q, _ = np.linalg.qr(out)
        self.axes = q
        self.vectors = _unit(np.stack([x @ q[at] for at, x in rows])).astype(np.float32) if k else np.zeros((0, k), np.float32)
        self.labels = labels.astype(np.float32)
        seen = {v: max(1, int((labels == v).sum())) for v in (0, 1)}
        weight = np.array([population.get(int(v), 0) / seen[int(v)] for v in labels], np.float32)
        self.weight = weight / weight.mean() if len(weight) else weight

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF vectors, each kind of terms with its weight."""
        x = _shares(counts) * self.idf
        for begin, end, weight in zip(KINDS, (*KINDS[1:], TERMS), WEIGHTS, strict=True):
            x[:, begin:end] = _unit(x[:, begin:end]) * weight
        return _unit(x)

    def scores(self, texts: list[str], hashes: WordHashes) -> np.ndarray:
        """Weighted share of label 1 among the nearest; near one half where nothing is near (empty texts, no labelled rows). Of equally near ones the first vote."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = [np.zeros(0)]
        for begin in range(0, len(texts), HELD):
            near = (self.weighted(np.stack([term_counts(t, hashes) for t in texts[begin : begin + HELD]])) @ self.axes) @ self.vectors.T
            at = np.argsort(-near.round(5), axis=1, kind="stable")[:, :NEIGHBOURS]
            weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(float) ** POWER * self.weight[at]
            out.append(((weight * self.labels[at]).sum(axis=1) + DOUBT / 2) / (weight.sum(axis=1) + DOUBT))
        return np.concatenate(out).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, train: object, text: str = "text", key: str = "doc_id", label: str = "quality") -> Votes:
    """``train``: condition on ``_key`` for rows that may be learnt from. Labels other than 0 and 1 are not learnt."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(F.col("_label").isin(0, 1)).where(train)
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    few, population = sample(known, body, PER_CLASS)

    def run(data: dict, hashes: WordHashes) -> dict:
        counts = [term_counts(t, hashes) for t in data["_text"]]
        at = [np.flatnonzero(c).astype(np.int32) for c in counts]
        return {"_key": data["_key"], "_label": data["_label"], "at": [a.tobytes() for a in at], "n": [c[a].tobytes() for c, a in zip(counts, at, strict=True)]}

    rows = per_batch(few, f"_key {dict(few.dtypes)['_key']}, _label int, at binary, n binary", run, WordHashes).collect()  # the bounded sample
    rows.sort(key=lambda r: (r["_key"], r["_label"], bytes(r["at"]), bytes(r["n"])))
    counts = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows]
    return Votes(counts, np.array([r["_label"] for r in rows]), population)


def score(docs: DataFrame, model: Votes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and ``score`` of every row; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * PER_CLASS vectors

    def run(data: dict, state: tuple[Votes, WordHashes]) -> dict:
        return {key: data[key], "score": state[0].scores(data["_text"], state[1])}

    return per_batch(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), f"`{key}` {dict(docs.dtypes)[key]}, score double", run, lambda: (sent.value, WordHashes()))


def accept(docs: DataFrame, model: Votes, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda texts, state: state[0].scores(texts, state[1]) >= least, lambda: (sent.value, WordHashes()))


def held_out(key: object) -> object:
    return fold(key, 4) == 2
