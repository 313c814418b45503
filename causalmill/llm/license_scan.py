"""License scans by ordered signature rules. DataFrame operations only.

One narrow pass over the texts: words, then the rules whose keywords all occur, then their regular expressions. Matches are marked in the text and
read back as word positions. A detection that lies inside another one of a better or the same priority is suppressed; the detections, which are few and
small beside the texts, are stored once and compared in windows, so neither a text full of notices nor a notice in every text is a hot spot.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage
from . import license_rules
from .decontaminate import words
from .license_rules import Rule

OPEN, CLOSE = "\x01", "\x02"  # never inside a word
RULE = "array<struct<rank:int,label:string,priority:int,weight:double,keywords:array<string>,pattern:string>>"


def _let(value: Column, use) -> Column:
    """``use`` of ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _rules(rules: list[Rule]) -> Column:
    return F.from_json(F.lit(json.dumps([{"rank": k, **r._asdict()} for k, r in enumerate(rules, 1)])), RULE)


def spaced(words_of: Column) -> Column:
    """The words as one string, a space on either side of each."""
    return F.when(F.size(words_of) > 0, F.concat(F.lit(" "), F.array_join(words_of, "  "), F.lit(" "))).otherwise("")


def spans(text: Column, pattern: Column) -> Column:
    """First and last word of every match of ``pattern`` in a ``spaced`` text, left to right, without overlaps."""
    marked = F.regexp_replace(text, pattern, F.lit(f" {OPEN} $0 {CLOSE} "))

    def of_tokens(tokens: Column) -> Column:
        marks = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i).isin(OPEN, CLOSE))
        return _let(marks, lambda m: F.transform(
            F.sequence(F.lit(0), (F.size(m) / 2).cast("int") - 1),
            lambda k: F.struct((F.get(m, 2 * k) - 2 * k).cast("long").alias("first"), (F.get(m, 2 * k + 1) - 2 * k - 2).cast("long").alias("last")),
        ))

    return _let(F.split(F.trim(marked), "  "), of_tokens)


def detections(text: Column, present: Column, rules: list[Rule]) -> Column:
    """All matches of the rules whose keywords are ``present``, as structs (first, last, rank, label, priority, weight)."""
    able = F.filter(_rules(rules), lambda r: (F.size(F.array_except(r["keywords"], present)) == 0) & F.rlike(text, r["pattern"]))
    return F.flatten(F.transform(able, lambda r: F.transform(spans(text, r["pattern"]), lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), r["rank"].alias("rank"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight"),
    ))))


def base_rules(phrases: dict[str, str]) -> list[Rule]:
    return [Rule(label, 0, license_rules.BASE_WEIGHT, tuple(phrase.split()), license_rules.pattern(phrase)) for phrase, label in phrases.items()]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: list[Rule] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: key, ``n_words``, ``base`` (places of the phrases) and ``found`` (what suppression leaves), both arrays of
    (first, last, rank, label, priority, weight), ordered by place; ``first`` and ``last`` count words from 0.

    A null or wordless text has no words and detections. Equal rows are answered alike, each on its own; keys may repeat or be null.
    Of equal intervals the better priority stays, then the earlier rule. An interval inside a longer one stays if its own priority is better.
    """
    rules = license_rules.rules() if rules is None else rules
    phrases = license_rules.BASE if phrases is None else phrases
    base = base_rules(phrases)
    every = sorted({k for r in [*rules, *base] for k in r.keywords})
    # a generated row is a barrier: the words are split once, whatever is asked of them later
    docs = docs.select(F.col(f"`{key}`").alias("_key"), words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_words"))
    docs = docs.select("_key", F.inline(F.array(F.struct("_words", F.array_intersect("_words", F.lit(every)).alias("_present")))))
    docs = docs.select("_key", F.inline(F.array(F.struct(
        F.size("_words").cast("long").alias("n_words"), "_present", F.when(F.size("_present") > 0, spaced(F.col("_words"))).otherwise("").alias("_text"),
    ))))
    none = F.array().cast("array<struct<first:bigint,last:bigint,rank:int,label:string,priority:int,weight:double>>")
    some = F.size("_present") > 0
    docs = docs.select(
        "_key", "n_words", F.when(some, detections(F.col("_text"), F.col("_present"), base)).otherwise(none).alias("base"),
        F.when(some, detections(F.col("_text"), F.col("_present"), rules)).otherwise(none).alias("_all"),
    )
    stored = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))  # the numbers stay, as the rows are stored with them

    plain = stored.where(F.size("_all") == 0).select(F.col("_key").alias(key), "n_words", F.array_sort("base").alias("base"), F.col("_all").alias("found"))
    held = stored.where(F.size("_all") > 0)
    at = held.select("_row", F.explode("_all").alias("d"))  # nothing else of the row, which may hold many
    before = Window.partitionBy("_row").orderBy("d.first", F.desc("d.last"), "d.priority", "d.rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    covered = F.lit(False)
    for level in levels:  # a detection that comes before and ends no sooner holds this one
        end = F.max(F.when(F.col("d.priority") == level, F.col("d.last"))).over(before)
        covered = covered | ((F.col("d.priority") >= level) & F.coalesce(end >= F.col("d.last"), F.lit(False)))
    left = at.withColumn("_in", covered).groupBy("_row").agg(F.array_sort(F.collect_list(F.when(~F.col("_in"), F.col("d")))).alias("found"))
    kept = held.join(left, "_row").select(F.col("_key").alias(key), "n_words", F.array_sort("base").alias("base"), "found")
    return plain.unionByName(kept)


def labelled(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest of a ``scan``: counts and ends of the base phrases, label lists, and the greatest weight as score."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    of = lambda c, field: F.transform(c, lambda d: d[field])
    return found.select(
        F.col(f"`{key}`"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(of("base", "first")).alias("first_word"), F.array_max(of("base", "first")).alias("last_word"),
        names(of("base", "label")).alias("base_labels"), names(F.concat(of("base", "label"), of("found", "label"))).alias("labels"),
        F.coalesce(F.array_max(F.concat(of("base", "weight"), of("found", "weight"))), F.lit(0.0)).alias("score"), F.size("found").cast("long").alias("n_found"),
    )
