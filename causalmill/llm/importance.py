"""Importance resampling towards a target distribution over hashed n-grams, whose checksums come from prefix checksums.

Each text is read once: its words, joined by one space, are run through crc32, and the running checksum after every word is stored. The checksum of a
run of words follows from the two prefixes at its ends: crc(ab) = shift(crc(a), |b|) xor crc(b), and the shift, a product with x^(8|b|) over GF(2), is
linear, so it is read off byte tables. No n-gram is ever built. Counts per bucket (a fixed number of them) are summed in each task before the shuffle.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut_lineage
from .common import slices

POLYNOMIAL = 0xEDB88320  # of crc32, bits reversed
#: A-Z become a-z; ASCII that is no letter or digit becomes a space; all other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SHORT = 6  # shifts by fewer than 2**SHORT bytes are read off one table
FULL = np.uint32(0xFFFFFFFF)


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


@functools.cache
def byte_table() -> np.ndarray:
    """What one byte does to the register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return t


def _apply(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A linear map given by its values on the four bytes."""
    out = tables[0][value & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][(value >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@functools.cache
def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Byte tables of the shifts by 0 to 2**SHORT - 1 zero bytes, and by 2**k zero bytes for every k from SHORT on."""
    one = byte_table()
    places = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    short = [places]
    for _ in range(1 << SHORT):
        v = short[-1]
        short.append((v >> np.uint32(8)) ^ one[v & 255])
    powers = [short[1 << SHORT]]
    for _ in range(SHORT, 40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(short[: 1 << SHORT]), powers


def shift(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``crc`` times x^(8 count) over GF(2), modulo the polynomial, element by element."""
    short, powers = shift_tables()
    low = count & ((1 << SHORT) - 1)
    out = short[low, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ short[low, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    high, k = count >> SHORT, 0
    while high.any():
        out = np.where(high & 1, _apply(powers[k], out), out)
        high, k = high >> 1, k + 1
    return out


def substring(before: np.ndarray, after: np.ndarray, count: np.ndarray) -> np.ndarray:
    """crc32 of the ``count`` bytes between two prefixes with checksums ``before`` and ``after``."""
    return after ^ shift(before, count)


def prefixes(text: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running checksum and length at the begin and at the end of every word of the words joined by one space."""
    n = len(text)
    sizes = np.fromiter(map(len, text), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    crc = zlib.crc32
    after = np.fromiter(accumulate(text[1:], lambda c, w: crc(w, crc(b" ", c)), initial=crc(text[0])), np.uint32, n)
    before = np.zeros(n, np.uint32)
    register = after[:-1] ^ FULL
    before[1:] = ((register >> np.uint32(8)) ^ byte_table()[(register ^ np.uint32(32)) & 255]) ^ FULL
    return before, after, ends - sizes, ends


def features(texts: list[str | None], n: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of every run of ``n[0]`` to ``n[1]`` words of each text, the number of runs and of words of each text; runs are grouped by text."""
    parts, runs, sizes = [], [], []
    for text in texts:
        found = words(text) if text else []
        m, here = len(found), 0
        if m:
            before, after, begin, end = prefixes(found)
            for k in range(n[0], min(n[1], m) + 1):
                parts.append(substring(before[: m - k + 1], after[k - 1 :], end[k - 1 :] - begin[: m - k + 1]))
                here += m - k + 1
        runs.append(here)
        sizes.append(m)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(runs, np.int64), np.array(sizes, np.int64)


def bucket_counts(docs: DataFrame, buckets: int, n: tuple[int, int], text: str = "text") -> DataFrame:
    """(``bucket``, ``n``): how many runs fall into each bucket that has any; every task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in (p for batch in batches for p in slices(batch)):
            total += np.bincount((features(part.column(0).to_pylist(), n)[0] % np.uint32(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(``bucket``, ``gain``) for all buckets: a thousand times the log ratio of smoothed shares in the target and in the source, rounded down."""
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()  # two numbers
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1.0) * F.lit(float(total["all_s"] + buckets)) / ((s + 1.0) * F.lit(float(total["all_t"] + buckets)))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, table: np.ndarray, n: tuple[int, int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``_key``, ``_text_hash``, ``n_words``, ``n_features`` and ``weight``, the mean gain of the row's runs rounded down (none: 0)."""
    buckets = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            crc, runs, sizes = features(part.column(2).to_pylist(), n)
            sums = np.concatenate([[0], np.cumsum(table[(crc % np.uint32(buckets)).astype(np.int64)])])
            ends = np.cumsum(runs)
            weight = np.where(runs > 0, (sums[ends] - sums[ends - runs]) // np.maximum(runs, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(runs, pa.int64()), pa.array(weight, pa.int64())], names=["_key", "_text_hash", "n_words", "n_features", "weight"]
            )

    given = docs.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_text_hash"), F.col(f"`{text}`").alias("_text"))
    return given.mapInArrow(run, f"_key {dict(docs.dtypes)[key]}, _text_hash long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """A thousand Gumbel draws, rounded down, fixed by the key and the seed; a null key counts as the text ``null``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, buckets: int = 10_000, n: tuple[int, int] = (1, 2), seed: int = 7, text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
    """Draw ``share`` per cent of the rows with ``least_words`` words or more, without replacement, by weight plus Gumbel noise.

    Per row of ``docs``: key, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (from 1; null if not drawn). Null texts have no words. Ties go to the
    smaller key, null keys last, then to the text's hash; repeated rows are drawn one by one. An empty target or corpus gives weights from smoothing alone.

    Scores are whole numbers between bounds set by 64-bit counts (a log ratio of at most 2**63 and Gumbel noise of 32 bits: fewer than 200,000 values),
    so the rows of each score are counted first: the cut and the rank before each score come from that table, and rows are ordered within a score only.
    """
    seen = cut_lineage(bucket_counts(docs, buckets, n, text))
    wanted = bucket_counts(target, buckets, n, target_text)
    table = np.zeros(buckets, np.int64)
    for row in gains(seen, cut_lineage(wanted), buckets).collect():  # ``buckets`` rows
        table[row["bucket"]] = row["gain"]
    rows = cut_lineage(weigh(docs, table, n, text, key).withColumn("score", F.col("weight") + noise(F.col("_key"), seed)))

    able = rows.where(F.col("n_words") >= least_words)
    counts = able.groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut_lineage(counts.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all")))
    drawn = counts.where(F.col("before") < F.floor(F.col("all") * share / 100)).select(F.col("score").alias("_score"), "before", F.floor(F.col("all") * share / 100).cast("long").alias("take"))

    joined = rows.join(F.broadcast(drawn), (F.col("score") == F.col("_score")) & (F.col("n_words") >= least_words), "left")
    found = joined.where("_score is not null").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("_score").orderBy(F.col("_key").asc_nulls_last(), "_text_hash")))
    names = [F.col("_key").alias(key), "n_words", "n_features", "weight", "score"]
    return found.select(*names, F.when(F.col("rank") <= F.col("take"), F.col("rank")).alias("rank")).unionByName(
        joined.where("_score is null").select(*names, F.lit(None).cast("long").alias("rank"))
    )
