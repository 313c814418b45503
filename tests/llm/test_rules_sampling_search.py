"""License scans, importance resampling and ranked search: against SQL, brute force, and on the odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from causalmill.llm import importance, license_rules, license_scan, ranked_search
from causalmill.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, _key string, _row string, score double, rank string, base string, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "k", "r", 1.0, "x", "b", "w") for i, t in enumerate(texts, start)], SCHEMA).repartition(3)


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns whose names clash."""
    long = " ".join(f"word{i % 977} MIT License x{i % 31}" for i in range(20_000))
    rows = [(1, "GNU General Public License, twice; cc by", "k", "r", 0.5, "x", "b", "w")] * 2 + [(None,) * 8, (2, "", None, None, None, None, None, None)]
    rows += [(3, long, "k", None, 1.0, "x", None, "w"), (4, " \n\t ", "k", "r", 1.0, "x", "b", "w"), (None, "no key here but an apache license", "k", "r", 1.0, "x", "b", "w")]
    rows += [(5, "éß \x00 😀 İ MIT LICENSE \x01 \x02", "k", "r", 0.0, "x", "b", "w"), (6, "a" * 300_000, "k", "r", 0.0, "x", "b", "w")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_importance_resampling", "op13_ranked_search"])
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


# ---- license scans

def brute_scan(text, rules):
    words, found = words_of(text), []
    spaced = f" {'  '.join(words)} " if words else ""
    for rank, r in enumerate(rules, 1):
        for m in re.finditer(r.pattern, spaced):
            first = len(spaced[: m.start()].split())
            found.append((first, first + len(m.group().split()) - 1, rank, r.label, r.priority))
    held = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and y[4] <= x[4] and (y[4] < x[4] or y[1] - y[0] > x[1] - x[0] or y[2] < x[2])
    return sorted(x[:4] for x in found if not any(held(x, y) for y in found))


def test_license_scan_brute_force(spark):
    rules, rnd = license_rules.rules(), random.Random(5)
    named = ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License version 3 or any later version",
             "under the terms of the MIT license", "CC BY-NC-SA 4.0", "https://creativecommons.org/licenses/by/4.0/", "released under the terms of the BSD 3-clause license", "All rights reserved",
             "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU Lesser General Public Licence v2.1 only", "Mozilla Public License 2.0", "LGPLv3", "WTFPL"]
    texts = [" ".join(rnd.choice(named) if rnd.random() < 0.3 else rnd.choice("the of license gnu public 2 0 mit version or later by cc under licensed x".split()) for _ in range(rnd.randint(0, 40))) for _ in range(60)] + named
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(d["first"], d["last"], d["rank"], d["label"]) for d in got[i].found] == brute_scan(t, rules), t
        words = words_of(t)
        places = sorted(k for p in license_rules.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert [d["first"] for d in got[i].base] == places and got[i].n_words == len(words)
    labels = {t: {d["label"] for d in got[i].found} for i, t in enumerate(texts)}
    assert labels[named[0]] == {"apache-2.0"} and labels[named[1]] == {"gpl-3.0-or-later"} and labels[named[2]] == {"gpl-3.0-or-later"}
    assert labels[named[4]] == {"cc-by-nc-sa-4.0"} and labels[named[5]] == {"cc-by-4.0"} and labels[named[6]] == {"bsd-3-clause"}


def test_license_keywords_are_needed():
    """The gate drops no match: whatever a pattern matches holds its keywords."""
    rules = license_rules.rules()
    assert len(rules) > 300 and all(r.keywords and 0 <= r.weight <= 1 for r in rules) and [r.priority for r in rules] == sorted(r.priority for r in rules)
    for r in rules:
        needed = re.sub(r"\(\?: [^()]* \)\?|\(\?:[^()]*\(\?:[^()]*\)[^()]*\)\?", "", r.pattern)  # without what may be left out
        assert all(f" {k} " in needed for k in r.keywords), r


def test_license_odd(odd, none):
    got = license_scan.labelled(license_scan.scan(odd)).collect()
    assert len(got) == odd.count() and sum(r.doc_id == 1 and r.base_labels == "cc-by,gpl" and r.n_base == 2 for r in got) == 2
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].labels) == (20_000, 1, 4 * 19_999 + 1, "mit") and by[3].n_words == 80_000
    assert (by[2].n_words, by[2].first_word, by[2].labels, by[2].score) == (0, None, "", 0.0) and by[5].base_labels == "mit" and by[6].n_words == 1
    assert sorted(r.base_labels for r in got if r.doc_id is None) == ["", "apache"]
    assert license_scan.labelled(license_scan.scan(none)).count() == 0
    again = license_scan.labelled(license_scan.scan(odd.where("doc_id = 3"))).where("labels = 'mit'")
    assert again.count() == 1


# ---- importance resampling

def test_checksums_of_substrings():
    rnd = random.Random(2)
    texts = ["", None, "one", "A b\tC-d é 😀x", "w" * 5000 + " tail", " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 90))) for _ in range(300))]
    crc, runs, sizes = importance.features(texts, (1, 3))
    want = []
    for t, n, size in zip(texts, runs, sizes):
        words = words_of(t)
        grams = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
        assert (n, size) == (len(grams), len(words))
        want += [zlib.crc32(g.encode()) for g in grams]
    assert crc.tolist() == want
    a, b = b"some prefix", rnd.randbytes(100_003)
    before, after = np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(a + b)], np.uint32)
    assert importance.substring(before, after, np.array([len(b)])).tolist() == [zlib.crc32(b)]


def brute_resample(rows, target, share, least):
    grams = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s = collections.Counter(bucket(g) for _, t in rows for g in grams(words_of(t)))
    t = collections.Counter(bucket(g) for x in target for g in grams(words_of(x)))
    ns, nt = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for key, text in rows:
        f = grams(words_of(text))
        weight = sum(math.floor(1000 * math.log((t[bucket(g)] + 1) * ns / ((s[bucket(g)] + 1) * nt))) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, [(r[0], r[4]) for r in able[: share * len(able) // 100]]


def test_resample_brute_force(spark, odd, none):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "beta", "Gamma", "x9"] + [f"v{i}" for i in range(60)]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts[10:14] = [texts[9]] * 4  # ties in weight
    target = docs_of(spark, ["alpha beta alpha gamma", None, ""])
    out = importance.resample(docs_of(spark, texts), target, share=25).collect()
    rows, drawn = brute_resample(list(enumerate(texts)), ["alpha beta alpha gamma"], 25, 20)
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out) == sorted(map(tuple, rows))
    assert [(r.doc_id, r.score) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, len(drawn) + 1))
    # repeated rows have equal scores and still get ranks of their own; null keys come last
    again = docs_of(spark, [texts[9]]).unionAll(docs_of(spark, [texts[9]])).unionAll(docs_of(spark, [texts[9]]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r["rank"] for r in importance.resample(again, target, share=100, least_words=1).collect()) == [1, 2, 3]
    rows, drawn = brute_resample([(r.doc_id, r.text) for r in odd.collect()], [], 50, 2)
    out = importance.resample(odd, none, share=50, least_words=2).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_features, r.score) for r in out)) == sorted((r[0] is None, r[0] or 0, r[2], r[4]) for r in rows)
    assert [r.doc_id for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])] == [d for d, _ in drawn]
    assert importance.resample(none, target).count() == 0


# ---- ranked search

def brute_rank(rows, items, k):
    texts = [(key, words_of(t)) for key, t in rows]
    texts = [(key, w) for key, w in texts if w]
    nn, ll = len(texts), sum(len(w) for _, w in texts)
    df = collections.Counter(t for _, w in texts for t in set(w))
    out = []
    for item, text in items:
        found = []
        for key, w in texts:
            tf, m = collections.Counter(w), 10 + (90 * len(w) * nn) // ll
            score = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(words_of(text)) if df[t])
            found.append((-score, key is None, key or 0, key))
        out += [(item, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(f for f in found if f[0])[:k], 1)]
    return out


def everything(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("rows", [3, 40, 4096])
def test_rank_brute_force(spark, rows, monkeypatch):
    rnd = random.Random(rows)
    monkeypatch.setattr(ranked_search, "SEGMENT_ROWS", rows)
    vocabulary = [f"t{int(rnd.paretovariate(0.6))}" for _ in range(400)] + ["Rare", "É"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))) for _ in range(250)] + ["t1 t2"] * 30 + [None, ""]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))) for _ in range(20)] + ["t1 t2", "t1", "rare T1 rare", "é", "nowhere", "", None]
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(map(repr, brute_rank(list(enumerate(texts)), list(enumerate(items)), 10)))
    assert everything(ranked_search.rank(docs_of(spark, texts), asked).select("item_id", "rank", "doc_id", "score")) == want
    monkeypatch.setattr(ranked_search, "ITEM_ROWS", 7)  # blocks of queries
    assert everything(ranked_search.rank(docs_of(spark, texts), asked).select("item_id", "rank", "doc_id", "score")) == want


def test_pair_bounds_skip_more():
    """The bound of two terms that never meet is the greater maximum, and fewer postings are read for the same answer."""
    rnd = np.random.default_rng(1)
    n, size = 400, 8
    lists = [np.flatnonzero(rnd.random(n) < 0.15).astype(np.int32) for _ in range(size)]
    impacts = [rnd.integers(1, 1000, len(d)) for d in lists]
    pairs = [(i, i + 1) for i in range(size - 1)]
    joint = []
    for a, b in pairs:
        both = np.intersect1d(lists[a], lists[b])
        joint.append((both, np.array([impacts[a][lists[a] == d][0] + impacts[b][lists[b] == d][0] for d in both], np.int64)))

    def segment(pair_maxima):
        arrays = {"docs": np.arange(n), "nulls": np.zeros(n, np.bool_), "terms": np.arange(size, dtype=np.int32), "starts": np.r_[0, np.cumsum([len(d) for d in lists])].astype(np.int32),
                  "postings": np.concatenate(lists), "impacts": np.concatenate(impacts), "maxima": np.array([i.max() for i in impacts]),
                  "pair_starts": np.r_[0, np.cumsum([len(j[0]) for j in joint])], "pair_postings": np.concatenate([j[0] for j in joint]).astype(np.int32),
                  "pair_impacts": np.concatenate([j[1] for j in joint]), "pair_maxima": np.array(pair_maxima)}
        return ranked_search.Segment({k: v.tobytes() for k, v in arrays.items()})

    tight = segment([int(j[1].max()) if len(j[1]) else 0 for j in joint])
    loose = segment([int(impacts[a].max() + impacts[b].max()) for a, b in pairs])
    number, query = {p: i for i, p in enumerate(pairs)}, np.arange(size, dtype=np.int32)
    assert ranked_search.units(tight, query, number)[1] < ranked_search.units(loose, query, number)[1]
    results, read = [], []
    for seg in (tight, loose):
        best, seen = ranked_search.Best(5), collections.Counter()
        for _ in range(2):  # the second walk knows a k-th score
            ranked_search.search_segment(seg, query, number, best, seen)
            best = ranked_search.Best(5) if best.least == 1 else best
        results.append((best.scores.tolist(), best.keys.tolist()))
        read.append(seen["read"])
    assert results[0] == results[1] and read[0] <= read[1]


def test_rank_odd(spark, odd, none):
    items = spark.createDataFrame([(None, "license MIT gnu"), (7, "license MIT gnu"), (7, "license MIT gnu"), (8, None), (9, "😀 i̇")], "item_id int, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(map(repr, brute_rank(rows, [tuple(r) for r in items.collect()], 3)))
    assert everything(ranked_search.rank(odd, items, k=3).select("item_id", "rank", "doc_id", "score")) == want
    assert ranked_search.rank(none, items).count() == 0 and ranked_search.rank(odd, items.limit(0)).count() == 0
    assert ranked_search.rank(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
