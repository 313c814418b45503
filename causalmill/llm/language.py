"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate step sizes, elastic-net penalties) on a bounded sample of rows per language, then
calibrated by one temperature on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, per_batch
from .sampling import sample

#: Rows learnt from per language; hash places of n-grams of 1 to 3 characters.
PER_CLASS, PLACES = 1_500, 1 << 15
#: Step size, its offset, elastic net (absolute and squared), passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.005, 0.001, 3
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Multipliers of the hash of an n-gram, fixed.
MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of 1 to 3 characters of the lower-cased text, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = c * MIX[0]
    two = one[:-1] ^ (c[1:] * MIX[1])
    three = two[:-1] ^ (c[2:] * MIX[2])
    places = np.concatenate([one >> np.uint32(17), (two * MIX[1]) >> np.uint32(17), (three * MIX[2]) >> np.uint32(17)]).astype(np.int64)
    counts = np.bincount(places, minlength=PLACES)
    at = np.flatnonzero(counts)
    return at, counts[at]


class Languages:
    """Fitted model: names, weights per name and place, idf, temperature."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.names = sorted({r[0] for r in rows})
        df = np.zeros(PLACES)
        for _, at, _ in rows:
            df[at] += 1
        self.idf = np.log((1 + len(rows)) / (1 + df)) + 1
        order = np.random.default_rng(11).permutation(len(rows))
        held = {int(i) for i in order[: len(rows) // 5]}
        learn = [int(i) for i in order if int(i) not in held] or list(range(len(rows)))
        index = {n: i for i, n in enumerate(self.names)}
        z, n = np.zeros((len(self.names), PLACES)), np.zeros((len(self.names), PLACES))
        bias = np.zeros(len(self.names))
        for _ in range(PASSES):
            for i in learn:
                name, at, count = rows[i]
                x = self._weigh(at, count)
                w = self._weights(z[:, at], n[:, at])
                g = self._softmax(w @ x + bias)
                g[index[name]] -= 1
                bias -= 0.02 * g
                step = np.outer(g, x)
                squared = n[:, at] + step**2
                z[:, at] += step - (np.sqrt(squared) - np.sqrt(n[:, at])) / ALPHA * w
                n[:, at] = squared
        self.weights = self._weights(z, n).astype(np.float32)
        self.bias = bias
        self.temperature = 1.0
        check = [(index[rows[i][0]], self._logits(rows[i][1], rows[i][2])) for i in sorted(held)]
        if check:
            truth, logits = np.array([c[0] for c in check]), np.stack([c[1] for c in check])

            def loss(t: float) -> float:
                p = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
                return -np.log(np.maximum(p[np.arange(len(p)), truth] / p.sum(axis=1), 1e-12)).mean()

            self.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))

    def _weigh(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[at]
        return x / max(1e-9, float(np.sqrt((x * x).sum())))

    @staticmethod
    def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        p = np.exp(x - x.max())
        return p / p.sum()

    def _logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self._weigh(at, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest name and its calibrated probability; ``und`` and 0 for texts without a letter, or if nothing was learnt."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = self._softmax(self._logits(*ngrams(text)) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(min(1.0, max(0.0, p[best])))


def fit(docs: DataFrame, train: object, text: str = "text", key: str = "doc_id", lang: str = "lang") -> Languages:
    """Learn from the rows with a language and a text for which ``train`` (a condition on ``_key``) holds."""
    known = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_label"), F.col(text).alias("_text")).where(train)
    few, _ = sample(known, None, PER_CLASS)

    def run(data: dict) -> dict:
        grams = [ngrams(t or "") for t in data["_text"]]
        return {"_key": data["_key"], "_label": data["_label"], "at": [g[0] for g in grams], "n": [g[1] for g in grams]}

    rows = per_batch(few, f"_key {dict(few.dtypes)['_key']}, _label string, at array<int>, n array<int>", run).collect()  # the bounded sample
    rows.sort(key=lambda r: (r["_key"], r["_label"], r["at"], r["n"]))
    return Languages([(r["_label"], np.array(r["at"], np.int64), np.array(r["n"], np.int64)) for r in rows if r["at"]])


def predict(docs: DataFrame, model: Languages, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, ``lang_pred`` and ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # PLACES numbers per language

    def run(data: dict, model: Languages) -> dict:
        found = [model.predict(t) for t in data["_text"]]
        return {key: data[key], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return per_batch(docs.select(key, F.col(text).alias("_text")), f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double", run, lambda: sent.value)


def held_out(key: object) -> object:
    return fold(key, 5) == 0
