"""The corpus pipeline: stages over ``documents``, each on all rows its predecessor kept. All but the last return the columns they were given."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir
from . import decontaminate, jaccard_join, quality, sentencepiece_codec, toxicity
from .common import one_of_each, read, row_key, without

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of a batch that a stage passes to Python, at most (one row may be longer). An executor holds a batch on both sides of the pipe for each of its
#: cores, and its workers keep the room they once needed through all later stages.
BATCH_BYTES = 1 << 21
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage: Stage) -> Stage:
    """The stage, in a session whose batches to Python hold at most BATCH_BYTES. The setting stays, as a stage runs when its result is written."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The labels of one fold in five are never learnt; without labels nothing is toxic."""
    chain = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("_key")))
    return toxicity.reject(docs, chain)


@in_small_batches
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below 0.7 go. Where no labelled row is left to learn from, no document can be rejected."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~quality.held_out(F.col("_key")))
    return quality.accept(docs, model) if len(model.labels) else docs


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 of their shingles of five words, the row with the least doc_id stays; of equal rows, one.

    Texts without words link with nothing and stay.
    """
    found = jaccard_join.link(docs.select(row_key().alias("doc_id"), "text")).select("doc_id", "component_id", "n_shingles")
    rest = without(docs, found.where("doc_id != component_id").select(F.col("doc_id").alias("_row")))
    # rows that are equal in key and text: rare, but all of them are the least of their component
    again = found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_row"))
    if again.isEmpty():
        return rest
    return without(rest, again).unionByName(one_of_each(rest, again))


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in 13-word windows of a benchmark item go."""
    found = decontaminate.hits(docs.select(row_key().alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return without(docs, found.where("20 * n_hit >= n_words").select(F.col("_key").alias("_row")))


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the kept texts with an end id, their spans and the decoded text, as digests."""
    return sentencepiece_codec.digest(docs, sentencepiece_codec.load_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode),
]

#: Two stages learn their models, which SQL can't express; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
