"""The queries of this package: each applies its operator to the whole table and derives the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    context_tree, decontaminate, html_text, importance, jaccard_join, language, license_rules, license_scan, multiset_hash, quality, ranked_search, sentencepiece_codec, sharding,
    toxicity,
)
from .common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return context_tree.score(docs, fold(F.col("_key"), 10) != 0).withColumn("held_out", fold(F.col("doc_id"), 10) == 0)


@query
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = language.fit(docs, ~language.held_out(F.col("_key")))
    return language.predict(docs, model).withColumn("held_out", language.held_out(F.col("doc_id")))


@query
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    chain = toxicity.fit(docs, read(spark, sf, "labels"), ~toxicity.held_out(F.col("_key")))
    return toxicity.tag(docs, chain).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans")
    )


@query
def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    model = sentencepiece_codec.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.digest(read(spark, sf, "documents"), model)


@query
def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read(spark, sf, "pages"))


@query
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = quality.fit(docs, read(spark, sf, "labels"), ~quality.held_out(F.col("_key")))
    return quality.score(docs, model).withColumns({"held_out": quality.held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.7).cast("int")})


@query
def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(read(spark, sf, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens"
    )


@query
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.link(read(spark, sf, "documents"), words=3, similarity=(90, 100))


@query
def op9_multiset_hash(spark: SparkSession, sf: str) -> DataFrame:
    return multiset_hash.edited(read(spark, sf, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Contaminated: a twentieth of the document's words or more lie inside windows of 13 words of an item."""
    out = decontaminate.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query
def op11_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.labelled(license_scan.scan(read(spark, sf, "documents")))


@query
def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    out = importance.resample(read(spark, sf, "documents"), read(spark, sf, "benchmark"), share=25, least_words=20, buckets=10_000, n=(1, 2), seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.rank(read(spark, sf, "documents"), read(spark, sf, "benchmark"), k=10)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op10_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s, w FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM iw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, item, s, k FROM dw JOIN win USING (k, phrase)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def _license_sql() -> str:
    """The same rules as values: matches are marked in the text and read back as word positions, then compared by containment."""
    every = [(r, False) for r in license_rules.rules()] + [(r, True) for r in license_scan.base_rules(license_rules.BASE)]
    rank = {r.pattern: k for k, (r, base) in reversed(list(enumerate(every, 1))) if not base}
    values = ",\n".join(f"({rank.get(r.pattern, 0)}, '{r.label}', {r.priority}, CAST({r.weight} AS DOUBLE), {base}, '{r.pattern}', {list(r.keywords)})" for r, base in every)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT r, w, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS s FROM d),
rule(rank, label, priority, weight, base, pattern, keys) AS (VALUES {values}),
mark AS (SELECT r, rank, label, priority, weight, base, string_split(trim(regexp_replace(s, pattern, ' ' || chr(1) || ' \\0 ' || chr(2) || ' ', 'g')), '  ') AS tok
         FROM (SELECT DISTINCT r, unnest(w) AS key FROM d) JOIN rule ON key = keys[1] JOIN t USING (r) WHERE list_has_all(w, keys) AND regexp_matches(s, pattern)),
place AS (SELECT * EXCLUDE (tok), list_filter(range(len(tok)), lambda i: tok[i + 1] IN (chr(1), chr(2))) AS m FROM mark),
det AS (SELECT * EXCLUDE (m, k), m[2 * k + 1] - 2 * k AS first, m[2 * k + 2] - 2 * k - 2 AS last FROM (SELECT *, unnest(range(len(m) // 2)) AS k FROM place)),
kept AS (SELECT * FROM det x WHERE base OR NOT EXISTS (SELECT 1 FROM det y WHERE y.r = x.r AND NOT y.base AND y.first <= x.first AND y.last >= x.last AND y.priority <= x.priority
         AND (y.priority < x.priority OR y.last - y.first > x.last - x.first OR y.rank < x.rank))),
agg AS (SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score, count(*) FILTER (NOT base) AS n_found FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score, coalesce(n_found, 0) AS n_found
FROM d LEFT JOIN agg USING (r)
"""


ORACLES["op11_license_scan"] = _license_sql()

# crc32 of each distinct run of words by its bytes and a table of 256 entries, which is made here by its rule
ORACLES["op12_importance_resampling"] = f"""
WITH RECURSIVE bits(b, c, k) AS (SELECT range, CAST(range AS BIGINT), 0 FROM range(256) UNION ALL SELECT b, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS tb FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]))) AS f FROM i),
fs AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
step(f, x, k, c) AS (SELECT f, hex(encode(f)), 0, 4294967295 FROM fs
    UNION ALL SELECT f, x, k + 1, xor(c >> 8, tb[CAST(xor(c & 255, CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)) AS BIGINT) + 1]) FROM step, tab WHERE 2 * k < len(x)),
crc AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM step WHERE 2 * k = len(x)),
dn AS (SELECT r, bucket, count(*) AS n FROM df JOIN crc USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM dn GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN crc USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n_features FROM dn JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(CASE WHEN total >= 0 THEN total // n_features ELSE -((-total + n_features - 1) // n_features) END, 0) AS BIGINT) AS weight,
       CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
       FROM d AS w LEFT JOIN w AS v USING (r)),
rk AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM rk
"""

_TERMS = _WORDS.replace("x3A-\\x60", "x3A-\\x40\\x5B-\\x60")
ORACLES["op13_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
qt AS (SELECT q, unnest(w) AS t FROM q),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
size AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, CAST(count(*) OVER () AS BIGINT) AS nn, CAST(sum(len(w)) OVER () AS BIGINT) AS ll FROM d WHERE len(w) > 0),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT count(*) FROM size) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf GROUP BY t),
sc AS (SELECT q, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
       FROM qt JOIN wt USING (t) JOIN tf USING (t) JOIN size USING (r) GROUP BY ALL),
rk AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM rk JOIN q USING (q) WHERE rank <= 10
"""
