"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not: features of words (the word, its beginnings) that toxic training documents hold far more often than others label
the tokens of those documents. A chain with two states is trained on the labelled tokens, and tags every token of every text: forward-backward gives the
probability of each token, the document score is the chance that any token is toxic, calibrated, and likely tokens give the offending offsets.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, keep_rows, per_batch
from .sampling import sample

#: Labelled documents learnt from, per label; the share of them kept back for calibration (1 of HELD).
PER_CLASS, HELD = 2_500, 5
#: Hash places of token features; tokens of a training sequence; sequences; rounds of training; penalty.
PLACES, LENGTH, SEQUENCES, ROUNDS, PENALTY = 1 << 18, 24, 24_000, 150, 1e-5
#: Features that label tokens, at most (the strongest); evidence they need: likelihood ratio, and documents.
SEEDS, EVIDENCE, DOCUMENTS = 20_000, 30.0, 3
#: Token probabilities below this don't add to a document's score; a token from SPAN on is an offending one.
FLOOR, SPAN = 0.02, 0.5
#: Words kept with their score, per task.
CACHE = 100_000
#: Tokens, with padding, whose marginals are worked out at once.
CELLS = 250_000
TOKEN = re.compile(r"\w+")


def beginnings(word: str) -> list[str]:
    """What may mark a word as toxic: itself, and its beginnings of 4 to 6 characters."""
    return ["=" + word, *[word[:n] for n in range(4, min(7, len(word)))]]


def places(word: str) -> list[int]:
    """Hash places of a word's features: the word, beginnings, endings, length."""
    features = ["=" + word, *["<" + word[:n] for n in range(4, min(7, len(word)))], *[">" + word[-n:] for n in range(3, min(5, len(word)))], f"#{min(len(word), 12)}"]
    return [xxhash.xxh32_intdigest(f.encode()) % PLACES for f in features]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def signature(words: list[str]) -> int:
    """Alike for most copies of a text with small changes: the least hash of its word triples."""
    return min((xxhash.xxh32_intdigest(" ".join(t).encode()) for t in zip(words, words[1:], words[2:], strict=False)), default=xxhash.xxh32_intdigest(" ".join(words).encode()))


class Chain:
    """States 0 and 1; the score of a token for state 1 is the sum of its features' weights, ``moves[i, j]`` scores going from i to j."""

    def __init__(self) -> None:
        self.weights = np.zeros(PLACES, np.float64)
        self.moves = np.zeros((2, 2))
        self.calibration = (1.0, 0.0)
        self.cache: dict[str, float] = {}

    # forward-backward ------------------------------------------------------------------------------------------------------------

    def marginals(self, emit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state 1) of each token, and expected moves, for sequences in rows (longest first); in odds, scaled so that state 0 has 1."""
        n, longest = emit.shape
        m = np.exp(self.moves)
        e = np.exp(np.clip(emit, -50, 50))
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]  # rows longer than t
        ahead = np.empty((n, longest))
        odds = e[:, 0].copy() if longest else np.zeros(n)
        if longest:
            ahead[:, 0] = odds
        for t in range(1, longest):
            k = active[t]
            odds = e[:k, t] * (m[0, 1] + m[1, 1] * odds[:k]) / (m[0, 0] + m[1, 0] * odds[:k])
            ahead[:k, t] = odds
        back = np.ones((n, longest))  # odds of what follows: state 1 to state 0
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            nxt = e[:k, t + 1] * back[:k, t + 1]
            back[:k, t] = (m[1, 0] + m[1, 1] * nxt) / (m[0, 0] + m[0, 1] * nxt)
        both = ahead * back
        return both / (1 + both), back

    def _moves(self, emit: np.ndarray, lengths: np.ndarray, p: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Expected number of each move."""
        if emit.shape[1] < 2:
            return np.zeros((2, 2))
        m = np.exp(self.moves)
        e = np.exp(np.clip(emit, -50, 50))
        ahead = p / np.maximum(1 - p, 1e-300) / back
        after = e[:, 1:] * back[:, 1:]
        parts = np.stack([m[0, 0] + 0 * after, m[0, 1] * after, ahead[:, :-1] * m[1, 0], ahead[:, :-1] * m[1, 1] * after])
        parts = parts / parts.sum(axis=0)
        there = np.arange(1, emit.shape[1])[None, :] < lengths[:, None]
        return np.where(there[None], parts, 0).sum(axis=(1, 2)).reshape(2, 2)

    # training --------------------------------------------------------------------------------------------------------------------

    def train(self, sequences: list[list[str]], tags: list[list[int]]) -> None:
        """Gradient steps with per-weight sizes on the likelihood of the tags, all sequences at once."""
        if not sequences:
            return
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sequences, tags = [sequences[i] for i in order], [tags[i] for i in order]
        vocabulary = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        features = [places(w) for w in vocabulary]
        flat, word_of = np.concatenate([np.array(f) for f in features]), np.repeat(np.arange(len(features)), [len(f) for f in features])
        lengths = np.array([len(s) for s in sequences])
        words = np.zeros((len(sequences), int(lengths.max())), np.int64)
        truth = np.zeros(words.shape)
        there = np.arange(words.shape[1])[None, :] < lengths[:, None]
        for i, (s, t) in enumerate(zip(sequences, tags, strict=True)):
            words[i, : len(s)] = [vocabulary[w] for w in s]
            truth[i, : len(s)] = t
        true_moves = np.zeros((2, 2))
        pairs = there[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                true_moves[a, b] = ((truth[:, :-1] == a) & (truth[:, 1:] == b) & pairs).sum()
        known_place = np.unique(flat)
        total = float(there.sum())
        state = {"w": (np.zeros(len(known_place)), np.zeros(len(known_place))), "m": (np.zeros((2, 2)), np.zeros((2, 2)))}
        compact = np.searchsorted(known_place, flat)
        weights = np.full(len(known_place), 0.0)
        for step in range(1, ROUNDS + 1):
            score = np.bincount(word_of, weights[compact], minlength=len(features))
            emit = np.where(there, score[words], 0)
            p, back = self.marginals(emit, lengths)
            wrong = np.where(there, p - truth, 0)
            by_word = np.bincount(words.ravel(), wrong.ravel(), minlength=len(features))
            gradient = {"w": np.bincount(compact, by_word[word_of], minlength=len(known_place)) / total + PENALTY * weights, "m": (self._moves(emit, lengths, p, back) - true_moves) / total + PENALTY * self.moves}
            for name, value in (("w", weights), ("m", self.moves)):
                first, second = state[name]
                first += 0.1 * (gradient[name] - first)
                second += 0.001 * (gradient[name] ** 2 - second)
                value -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        self.weights[known_place] = weights

    # scoring ---------------------------------------------------------------------------------------------------------------------

    def emissions(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        except KeyError:
            if len(cache) >= CACHE:
                cache.clear()
            new = list(set(words).difference(cache))
            found = [places(w) for w in new]
            sums = np.bincount(np.repeat(np.arange(len(new)), [len(f) for f in found]), self.weights[[p for f in found for p in f]], minlength=len(new))
            cache.update(zip(new, sums.tolist(), strict=True))
            return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of each token of each text."""
        emits = [self.emissions(tokens(t)) for t in texts]
        lengths = np.array([len(e) for e in emits])
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):  # rows of like length, so that padding stays small
            longest = int(lengths[order[at]])
            if longest == 0:
                break
            end = at + 1
            while end < len(order) and lengths[order[end]] * 2 >= longest and (end - at + 1) * longest <= CELLS:
                end += 1
            part = [i for i in order[at:end] if lengths[i]]
            emit = np.zeros((len(part), longest))
            for r, i in enumerate(part):
                emit[r, : lengths[i]] = emits[i]
            p, _ = self.marginals(emit, lengths[part])
            for r, i in enumerate(part):
                out[i] = p[r, : lengths[i]]
            at = end
        return out

    @staticmethod
    def strength(p: np.ndarray) -> float:
        """Log-odds that any token is toxic, of those whose probability is not small."""
        likely = p[p >= FLOOR]
        clean = float(np.log1p(-np.minimum(likely, 1 - 1e-9)).sum()) if len(likely) else math.log1p(-FLOOR / 2)
        return float(np.clip(math.log(-math.expm1(clean)) - clean, -10, 10))

    def score(self, p: np.ndarray) -> float:
        slope, offset = self.calibration
        return 1 / (1 + math.exp(-(slope * self.strength(p) + offset)))

    def calibrate(self, strengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Logistic fit of the labels by Newton steps, with a small penalty towards slope 1."""
        slope, offset = 1.0, 0.0
        for _ in range(50):
            z = np.clip(slope * strengths + offset, -30, 30)
            q = 1 / (1 + np.exp(-z))
            g = np.array([(weights * (q - labels) * strengths).sum() + (slope - 1), (weights * (q - labels)).sum() + 0.1 * offset])
            c = weights * q * (1 - q)
            h = np.array([[(c * strengths**2).sum() + 1, (c * strengths).sum()], [(c * strengths).sum(), c.sum() + 0.1]])
            move = np.linalg.solve(h, g)
            slope, offset = slope - float(np.clip(move[0], -1, 1)), offset - float(np.clip(move[1], -2, 2))
        self.calibration = (max(0.1, slope), offset)


def seeds(few: DataFrame) -> set[str]:
    """Word features that mark toxic documents: log-likelihood ratio over documents, near copies counted once."""

    def run(data: dict) -> dict:
        out: dict[str, list] = {"sig": [], "toxic": [], "feature": []}
        for label, text in zip(data["_label"], data["_text"], strict=True):
            words = tokens(text)
            out["sig"].append(signature(words))
            out["toxic"].append(label)
            out["feature"].append(sorted({f for w in set(words) for f in beginnings(w)}))
        return out

    docs = per_batch(few, "sig bigint, toxic int, feature array<string>", run).dropDuplicates(["sig", "toxic"])
    counted = docs.select("toxic", F.explode("feature").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    size = few.groupBy().agg(F.sum("_label").alias("a"), F.sum(1 - F.col("_label")).alias("b")).first()
    toxic, clean = size["a"] or 0, size["b"] or 0
    if not toxic or not clean:
        return set()
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / float(toxic + clean)
    ratio = 2 * (a * F.log(a / (share * toxic)) + F.when(b > 0, b * F.log(b / (share * clean))).otherwise(0.0))
    strong = counted.where(a >= DOCUMENTS).withColumn("ratio", ratio).where((F.col("ratio") >= EVIDENCE) & (a / toxic > 10 * b / clean))
    return {r["feature"] for r in strong.orderBy(F.desc("ratio"), "feature").limit(SEEDS).collect()}  # the strongest SEEDS features


def fit(docs: DataFrame, labels: DataFrame, train: object, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Chain:
    """Learn from a bounded sample of the labelled rows for which ``train`` (a condition on ``_key``) holds. Labels other than 0 and 1 are not learnt."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(F.col("_label").isin(0, 1)).where(train)
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    few, population = sample(known, body, PER_CLASS)
    few = few.withColumn("_label", F.col("_label").cast("int")).persist()
    marks = seeds(few)

    def cut(data: dict) -> dict:
        """Sequences with tags: around marked tokens of toxic documents, and evenly spaced ones of all."""
        out: dict[str, list] = {c: [] for c in ("_key", "_label", "held", "words", "tags")}
        for k, y, t in zip(data["_key"], data["_label"], data["_text"], strict=True):
            words = tokens(t)
            held = xxhash.xxh32_intdigest(str(k).encode()) % HELD == 0
            marked = [int(y == 1 and not marks.isdisjoint(beginnings(w))) for w in words]
            hits = Counter(i // LENGTH for i, m in enumerate(marked) if m)
            pieces = range(0, len(words), LENGTH)
            wanted = {p // LENGTH for p in pieces[:: max(1, len(pieces) // 4)]} | {p for p, _ in hits.most_common(4)}
            # a toxic document without a marked token says nothing about its tokens
            for p in sorted(wanted) if y == 0 or hits else []:
                out["_key"].append(k)
                out["_label"].append(y)
                out["held"].append(held)
                out["words"].append(words[p * LENGTH : (p + 1) * LENGTH])
                out["tags"].append(marked[p * LENGTH : (p + 1) * LENGTH])
        return out

    kind = dict(few.dtypes)["_key"]
    cuts = per_batch(few, f"_key {kind}, _label int, held boolean, words array<string>, tags array<int>", cut)
    rows = [r for r in cuts.collect() if r["words"]]  # at most 8 pieces of a document of the bounded sample
    rows.sort(key=lambda r: (xxhash.xxh32_intdigest(f"{r['_key']} {' '.join(r['words'])}".encode()), r["words"]))
    learn = [r for r in rows if not r["held"]][:SEQUENCES]
    chain = Chain()
    chain.train([r["words"] for r in learn], [r["tags"] for r in learn])
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def measure(data: dict, model: Chain) -> dict:
        keep = [i for i, k in enumerate(data["_key"]) if xxhash.xxh32_intdigest(str(k).encode()) % HELD == 0]
        found = model.tag([data["_text"][i] for i in keep])
        return {"_label": [data["_label"][i] for i in keep], "s": [Chain.strength(p) for p in found]}

    held = sorted(tuple(r) for r in per_batch(few, "_label int, s double", measure, lambda: sent.value).collect())
    few.unpersist()
    y, s = np.array([h[0] for h in held], float), np.array([h[1] for h in held], float)
    if len(y):
        seen = {v: max(1, int((y == v).sum())) for v in (0, 1)}
        total = sum(population.values())
        chain.calibrate(s, y, np.array([population.get(int(v), 0) / total / seen[int(v)] * len(y) for v in y]))
    return chain


def tag(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``score`` and ``spans``, an array of (start, end, probability) of the offending tokens in code points of the text.

    A null or empty text has no tokens and gets the score of a text in which nothing is likely.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # PLACES weights

    def run(data: dict, model: Chain) -> dict:
        found = model.tag(data["_text"])
        spans = []
        for t, p in zip(data["_text"], found, strict=True):
            bad = set(np.flatnonzero(p >= SPAN).tolist())
            low = t.lower() if bad else ""
            # lower-casing may change a text's length; offsets then come from the words as they stand
            where = TOKEN.finditer(low if len(low) == len(t) else t) if bad else ()
            spans.append([{"start": m.start(), "end": m.end(), "probability": float(p[i])} for i, m in enumerate(where) if i in bad])
        return {key: data[key], "score": [model.score(p) for p in found], "spans": spans}

    schema = f"`{key}` {dict(docs.dtypes)[key]}, score double, spans array<struct<start:int,end:int,probability:double>>"
    return per_batch(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), schema, run, lambda: sent.value)


def reject(docs: DataFrame, chain: Chain, above: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose score is below ``above``, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    return keep_rows(docs, text, lambda texts, model: [model.score(p) < above for p in model.tag(texts)], lambda: sent.value)


def held_out(key: object) -> object:
    return fold(key, 5) == 0
