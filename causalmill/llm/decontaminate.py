"""Benchmark decontamination over a distributed positional inverted index.

Postings (document, position, term) are stored for the rarest terms of each test passage only. Their positions, less the offsets of the terms in the
passage, are intersected: where the two rarest terms of a window meet on one diagonal, the window may occur. The remaining terms of those few
candidates are then compared in the document itself, so the answer is exact. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage
from .common import lower_ascii, sent

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII, in order; none for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(low, NOT_WORD), "")


def postings(docs: DataFrame, terms: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The index: one row (key, ``pos``, ``term``) for each word of ``docs`` that is in ``terms``."""
    at = docs.select(*key, F.posexplode(words(F.col(text))).alias("pos", "term"))
    return at.join(sent(terms.select("term").distinct()), "term")


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """How often each of ``terms`` occurs in all of ``docs``; terms that don't occur are left out."""
    return docs.select(F.explode(words(F.col(text))).alias("term")).join(sent(terms.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("n"))


def hits(docs: DataFrame, items: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The distinct rows of ``docs`` in which a window of an item occurs, stored: ``_key``, ``_hash`` (of the text), ``n_words``, ``n_hit``, ``item_ids``; see ``contamination``.

    Only candidates are read again in full, so a filter on the answer costs nothing.
    """
    docs = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    tests = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("null")).alias("item_id"), words(F.coalesce(F.col(item_text), F.lit(""))).alias("item_words"))
    tests = tests.where(F.size("item_words") > 0).distinct().withColumn("item", F.xxhash64("item_id", F.concat_ws(" ", "item_words")))
    tests = cut_lineage(tests)
    length = F.least(F.lit(window), F.size("item_words"))
    terms = tests.select(F.explode("item_words").alias("term")).distinct()
    counts = cut_lineage(term_counts(docs, terms, "_text"))

    # the two rarest terms of each window; a window with a term that no document has cannot occur
    spread = tests.select("item", "item_words", F.explode(F.sequence(F.lit(0), F.size("item_words") - length)).alias("start"))
    spread = spread.select("item", "start", F.posexplode(F.slice("item_words", F.col("start") + 1, length)).alias("at", "term"))
    spread = spread.select("item", "start", (F.col("start") + F.col("at")).alias("ipos"), "term").join(sent(counts), "term", "left")
    of_window = Window.partitionBy("item", "start")
    ranked = spread.withColumn("rank", F.row_number().over(of_window.orderBy("n", "term", "ipos"))).withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(of_window))
    anchors = cut_lineage(ranked.where("rank <= 2 and least > 0").select("item", "start", "rank", "ipos", "term"))
    pairs = anchors.groupBy("item", "start").agg(F.collect_set("ipos").alias("pair")).groupBy("item").agg(F.collect_set("pair").alias("pairs"))

    index = cut_lineage(postings(docs, anchors, ["_key", "_hash"], "_text"))
    met = (
        index.join(sent(anchors.select("term", "item", "ipos").distinct()), "term")
        .groupBy("_key", "_hash", "item", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(F.collect_set("ipos").alias("seen"))
    )
    found = met.join(sent(pairs), "item").where(F.exists("pairs", lambda p: F.size(F.array_except(p, F.col("seen"))) == 0))
    candidates = found.groupBy("_key", "_hash").agg(F.collect_set(F.struct("item", "diagonal")).alias("found"))
    candidates = cut_lineage(candidates.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "found"))

    # the words of a candidate, compared on its diagonal; starts of the windows that occur
    same_row = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
    read = docs.join(sent(candidates, size=16 * F.size("found")), same_row).select("_key", "_hash", "found", words(F.col("_text")).alias("_words"))
    read = read.select("_key", "_hash", "_words", F.inline("found")).join(sent(tests, size=F.length(F.concat_ws(" ", "item_words"))), "item")
    n, at = F.size("item_words"), F.col("diagonal")
    same = F.concat_ws("", F.transform("item_words", lambda w, i: F.when(F.get(F.col("_words"), at + i) == w, "1").otherwise("0")))
    read = read.select("_key", "_hash", F.size("_words").cast("long").alias("n_words"), "item_id", "diagonal", F.least(F.lit(window), n).alias("long"), F.inline(F.array(F.struct(same.alias("same")))))
    starts = F.filter(F.sequence(F.lit(0), F.length("same") - F.col("long")), lambda s: F.substr("same", s + 1, F.col("long")) == F.repeat(F.lit("1"), F.col("long")))
    read = read.select("_key", "_hash", "n_words", "item_id", F.flatten(F.transform(starts, lambda s: F.sequence(at + s, at + s + F.col("long") - 1))).alias("positions"))
    return cut_lineage(read.where(F.size("positions") > 0).groupBy("_key", "_hash").agg(
        F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    ))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, ``n_hit`` (words inside an occurrence of a window of an item), ``item_ids`` (sorted strings).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer (but some). Null or wordless texts have no words and
    hits; a null item key is reported as the text ``null``. Equal rows are answered alike, each on its own.
    """
    found = hits(docs, items, window, text, key, item_key, item_text).select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "n_hit", "item_ids")
    out = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    out = out.join(sent(found, size=F.length(F.concat_ws(",", "item_ids"))), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    return out.select(
        F.col("_key").alias(key), F.size(words(F.col("_text"))).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def proximity(index: DataFrame, queries: DataFrame, within: int, key: list[str]) -> DataFrame:
    """Documents that hold all terms of a query, each at most ``within`` words from an occurrence of the query's rarest term.

    ``index``: postings; ``queries``: (``query``, ``term``). Rows: key, ``query``, ``pos`` (of the rarest term). Positions are cut into
    stretches of ``within`` words, so a term's postings meet only those of its own and the neighbouring stretches.
    """
    queries = queries.select("query", "term").where("term is not null").distinct()
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    ranked = queries.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("n", "term"))).withColumn("terms", F.count("*").over(Window.partitionBy("query")))
    stretch = F.floor(F.col("pos") / max(1, within))
    at = index.distinct().join(sent(ranked), "term")
    first = at.where("rank = 1").select(*key, "query", "terms", F.col("pos").alias("at"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    rest = at.where("rank > 1").select(*key, "query", "pos", "term", stretch.alias("stretch"))
    near = first.join(rest, [*key, "query", "stretch"], "left").withColumn("term", F.when(F.abs(F.col("pos") - F.col("at")) <= within, F.col("term")))
    full = near.groupBy(*key, "query", "at", "terms").agg(F.count_distinct("term").alias("others")).where("others = terms - 1")
    return full.select(*key, "query", F.col("at").alias("pos"))
