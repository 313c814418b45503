"""What the operators of this package share: folds, text columns and passing batches through Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import row_bound

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Rows handed to Python at a time, and bytes of text they may hold (one row may be longer); such a slice is what a task holds besides its input batch.
SLICE, SLICE_BYTES = 512, 1 << 20
#: A table of at most this many rows is sent to every executor; a longer one is joined by shuffle, with the same result.
SENT_ROWS = 200_000
#: So is one of at most this many bytes, where rows have no fixed width.
SENT_BYTES = 1 << 25
#: Words kept with their hash, per task.
WORDS = 100_000


class WordHashes:
    """64-bit hashes of the words of a text, in order: A-Z lower-cased, words between ASCII white space."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(cache) >= WORDS:
                cache.clear()
            for w in set(words).difference(cache):
                cache[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str) -> list[bytes]:
    """Bytes split at space, tab, line feed, vertical tab, form feed and carriage return; only A-Z are lower-cased."""
    return text.encode().lower().split()


C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def sent(df: DataFrame, limit: int = SENT_ROWS, size: Column | None = None) -> DataFrame:
    """Marked for sending if it is counted and short; ``size`` gives the bytes of rows that have no fixed width."""
    if size is None:
        return F.broadcast(df) if row_bound(df, limit) <= limit else df
    rows, held = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if rows <= limit and (held or 0) <= SENT_BYTES else df


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and SLICE_BYTES bytes of text; a longer row is a slice of its own."""
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(held)
    begin = 0
    while begin < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_BYTES, side="right"))
        end = min(begin + rows, batch.num_rows, max(begin + 1, full))
        yield batch.slice(begin, end - begin)
        begin = end


def per_batch(df: DataFrame, schema: str, fn: Callable[..., dict[str, object]], setup: Callable[[], object] | None = None, rows: int = SLICE) -> DataFrame:
    """Map slices of at most ``rows`` rows: ``fn`` gets {column: list} (and what ``setup`` made once per task), gives {column: values}.

    The work is narrow, holds one slice at a time, and a lost task is simply run again.
    """
    names = [f.name for f in _fields(schema)]
    arrow = {f.name: _arrow_type(f.dataType) for f in _fields(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in slices(batch, rows):
                data = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                out = fn(data, state) if setup else fn(data)
                yield pa.RecordBatch.from_arrays([_array(out[n], arrow[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, keep: Callable[[list[str], object], Sequence[bool]], setup: Callable[[], object], rows: int = SLICE) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text (null: empty) ``keep`` accepts."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup()
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            kept = [bool(k) for part in slices(texts, rows) for k in keep([t or "" for t in part.column(0).to_pylist()], state)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def row_key(text: str = "text", key: str = "doc_id") -> Column:
    """Identifies a row even where keys repeat or are null; only equal rows share it."""
    return F.struct(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def _marked(df: DataFrame) -> DataFrame:
    """All columns as one (so that no name can clash), and the ``row_key``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), row_key().alias("_row"))


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``row_key`` is not among ``keys`` (column ``_row``)."""
    return _marked(df).join(sent(keys.select("_row").distinct()), "_row", "left_anti").select("_all.*")


def one_of_each(df: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``df`` for each ``row_key`` among ``keys`` (column ``_row``)."""
    found = _marked(df).join(sent(keys.select("_row").distinct()), "_row", "left_semi")
    return found.groupBy("_row").agg(F.first("_all").alias("_all")).select("_all.*")


def _array(values: object, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _fields(schema: str) -> Sequence:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow_type(kind: object) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
