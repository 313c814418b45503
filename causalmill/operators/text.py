"""Text corpus: chunking, titles, embeddings, retrieval, context packs.

Chunk tables have document_id, chunk_id, content, metadata map<string,string> and, for retrieval, embedding array<float>.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from itertools import groupby
from urllib.parse import quote, unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut_lineage

EMPTY = "[Empty file]"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPEN_COST = "64k"  # opening a file counts as reading so much when files are dealt to tasks; Spark's 4 MB would make a task of 32 files
WORD_BREAK = r"[^\p{L}\p{N}_]+"
RULE = "\n\n---\n\n"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chunk_paragraphs(df: DataFrame, text: str, key: Sequence[str], separator: str = "\n\n") -> DataFrame:
    """(key…, chunk_id, content): trimmed non-empty paragraphs with their index; a text without any gives one placeholder."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda p, i: F.struct(i.cast("int").alias("chunk_id"), _strip(p).alias("content")))
    full = F.filter(parts, lambda s: s["content"] != "")
    placeholder = F.array(F.struct(F.lit(0).alias("chunk_id"), F.lit(EMPTY).alias("content")))
    return df.select(*key, F.inline(F.when(F.size(full) > 0, full).otherwise(placeholder)))


def _pieces(text: str, separators: Sequence[str], size: int) -> list[str]:
    """Cut at the coarsest separator that occurs; pieces that are still too long are cut at the next finer one."""
    sep = next((s for s in separators if s and s in text), "")
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    finer = list(separators)[list(separators).index(sep) + 1 :]
    out = []
    for i, part in enumerate(text.split(sep)):
        part = part if i == 0 else sep + part  # a separator stays with the piece after it
        out += [part] if len(part) <= size else _pieces(part, finer, size)
    return [p for p in out if p]


def recursive_chunks(text: str, size: int, overlap: int, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters built from whole pieces; each starts with up to ``overlap`` characters of the last."""
    chunks, window, length = [], [], 0
    for piece in _pieces(text, separators, size):
        if window and length + len(piece) > size:
            chunks.append("".join(window).strip())
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        chunks.append("".join(window).strip())
    return [c for c in chunks if c]


def chunk_recursive(df: DataFrame, text: str, key: Sequence[str], size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key…, chunk_id, content) by recursive character splitting."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_chunks(t or "", size, overlap))

    return df.select(*key, F.posexplode(split(F.col(text))).alias("chunk_id", "content"))


def chunk_stride(df: DataFrame, text: str, key: Sequence[str], size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key…, chunk_id, content): windows of ``size`` characters every ``size - overlap``; JVM only."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    rows = df.where(F.length(text) > 0).select(*key, F.col(text).alias("_t"), F.explode(starts).alias("_i"))
    return rows.select(*key, F.col("_i").cast("int").alias("chunk_id"), F.substring(F.col("_t"), (F.col("_i") * step + 1).cast("int"), F.lit(size)).alias("content"))


# fixed values: beginnings and parts that rule a line out as a title
NOT_TITLE_START = ["#", "<", "<!--", "/*", "```", "title:", "author:", "date:"]
NOT_TITLE_PART = ["http", "www"]


def extract_title(text: Column) -> Column:
    """First non-empty line when it is 6 to 199 characters, plain and without a link; otherwise empty."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _strip), lambda s: s != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))

    def title(line: Column) -> Column:
        low = F.lower(line)
        bad = F.lit(False)
        for s in NOT_TITLE_START:
            bad = bad | low.startswith(s)
        for s in NOT_TITLE_PART:
            bad = bad | low.contains(s)
        return F.when((F.length(line) > 5) & (F.length(line) < 200) & ~bad, line).otherwise("")

    # inside a lambda the line is a variable: the text is split once, not once per test
    return F.get(F.transform(F.array(first), lambda line: title(line)), F.lit(0))


def sanitize_metadata(df: DataFrame, columns: Sequence[str], output: str = "metadata") -> DataFrame:
    """Pack columns into map<string,string>: scalars as text, lists joined by comma, other values as JSON, nulls left out."""
    pairs = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        if kind.startswith("array<"):
            value = F.array_join(F.col(c).cast("array<string>"), ", ")
        elif kind.startswith(("struct<", "map<")):
            value = F.to_json(c)
        else:
            value = F.col(c).cast("string")
        pairs.append(F.struct(F.lit(c).alias("k"), value.alias("v")))
    kept = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())
    return df.withColumn(output, F.map_from_entries(kept))


def ingest_new(
    spark: SparkSession, folder: str, stored: DataFrame | None = None, patterns: str = "*.{txt,md}", limit: int | None = None, separator: str = "\n\n"
) -> tuple[DataFrame, DataFrame]:
    """(chunks, files): text files under ``folder`` whose name is not in ``stored`` (document_id), cut into paragraphs.

    ``files`` lists every file with status new or stored; ``limit`` takes the first files by name.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", patterns).text(folder, wholetext=True)
    files = raw.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("document_id", F.regexp_extract("path", r"([^/]+)$", 1))
    known = files.select("document_id").limit(0) if stored is None else stored.select("document_id").distinct()
    fresh = files.join(known, "document_id", "left_anti")
    if limit is not None:
        fresh = fresh.join(fresh.select("path").orderBy("path").limit(limit), "path", "left_semi")
    chunks = chunk_paragraphs(fresh.withColumn("title", extract_title(F.col("text"))), "text", ["document_id", "path", "title"], separator)
    taken = fresh.select("path", F.lit("new").alias("status"))
    listing = files.select("path", "document_id").join(taken, "path", "left").na.fill("stored", ["status"])
    return chunks, listing


@contextmanager
def listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While it lasts, listing or reading many small files takes about four tasks per core: a listing not one for each folder, a read not one for 32 files."""
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    new = {LISTING: tasks, "spark.sql.files.minPartitionNum": tasks, "spark.sql.files.openCostInBytes": OPEN_COST}
    before = {name: spark.conf.get(name, None) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # Spark's name for a folder of rows without a key
FILES_PER_FOLDER = 250


def _to_files(folder: str, key: str):
    """For ``mapInArrow`` over rows (key, text) sorted by key: writes a file per key below ``folder`` and gives the number of files."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = TaskContext.get().partitionId(), 0
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for k, same in groupby(rows, key=lambda row: row[0]):
            to = os.path.join(folder, f"{task:05d}-{files // FILES_PER_FOLDER:05d}")
            if files % FILES_PER_FOLDER == 0:
                os.makedirs(to, exist_ok=True)
            with open(os.path.join(to, f"{key}={NO_KEY if k is None else quote(k)}.txt"), "wb") as f:
                f.writelines((text or b"") + b"\n" for _, text in same)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def write_files(df: DataFrame, key: str, text: str, folder: str) -> None:
    """Write one text file per value of ``key`` below ``folder``, its name or that of its folder being key=value; a line per row.

    On a file system of the machines, Spark's writer starts three processes per file to set permissions; there the tasks write the files themselves, a few
    hundred to a folder. A task that is run again writes the same names.
    """
    rows = df.select(key, text).repartition(key)
    if urlparse(folder).scheme not in ("", "file"):
        rows.write.partitionBy(key).text(folder)
        return
    rows = rows.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias(key), F.col(text).cast("binary").alias(text)).sortWithinPartitions(key)
    rows.mapInArrow(_to_files(unquote(urlparse(folder).path), key), "files long").agg(F.sum("files")).collect()


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
PACKED = {"gz", "bz2", "deflate", "snappy", "lz4", "zst", "zstd", "xz"}


def _plain(patterns: str) -> bool:
    """Whether only files match that Spark's text reader would not unpack."""
    names = re.fullmatch(r"\*\.(?:(\w+)|\{([\w,]+)\})", patterns)
    return names is not None and not PACKED & set((names[1] or names[2]).lower().split(","))


def ingest_stream(
    spark: SparkSession, folder: str, store: str, progress: str, run: str, patterns: str = "*.{txt,md}", separator: str = "\n\n",
    document_id: str = r"([^/]+)$", files_per_batch: int = 20_000,
) -> DataFrame:
    """Read the files under ``folder`` that no earlier call has read, add their chunks to ``store``, and return the table of all chunks.

    A file stream that ends when nothing new is left: its log in ``progress`` is the record of what is stored, so a file is read once even if a run is
    broken off and started again, and files of any number go through in batches. Files of no bytes are passed over. ``document_id`` takes the id from the path; ``run`` names the call in the table.
    A listing is cut into a few tasks per core, not one per folder or file, and so is a batch. Files are read as bytes where none can be packed, as the text
    reader copies Hadoop's settings for each file.
    """
    with listing_tasks(spark):
        plain = _plain(patterns)
        raw = (
            spark.readStream.format("binaryFile" if plain else "text").options(**{} if plain else {"wholetext": True}).option("recursiveFileLookup", True)
            .option("pathGlobFilter", patterns).option("maxFilesPerTrigger", files_per_batch).schema(BINARY_FILE if plain else "value string").load(folder)
        )
        whole = raw.where("length > 0").select("_metadata.file_path", F.col("content").cast("string").alias("text")) if plain else raw.select("_metadata.file_path", F.col("value").alias("text"))
        files = whole.withColumnRenamed("file_path", "path").withColumn("document_id", F.regexp_extract("path", document_id, 1))
        chunks = chunk_paragraphs(files.withColumn("title", extract_title(F.col("text"))), "text", ["document_id", "path", "title"], separator)
        query = chunks.withColumn("run", F.lit(run)).writeStream.format("parquet").option("path", store).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(chunks.withColumn("run", F.lit(run)).schema).parquet(store)


def list_documents(chunks: DataFrame) -> DataFrame:
    """(document_id, chunks, characters, metadata of the first chunk)."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("characters"), F.min_by("metadata", "chunk_id").alias("metadata")
    )


def get_chunks(chunks: DataFrame, document_ids: Sequence | DataFrame) -> DataFrame:
    if isinstance(document_ids, DataFrame):
        return chunks.join(document_ids.select("document_id").distinct(), "document_id", "left_semi")
    return chunks.where(F.col("document_id").isin(list(document_ids)))


def delete_chunks(chunks: DataFrame, document_ids: Sequence | DataFrame) -> DataFrame:
    """The table without the given documents."""
    if isinstance(document_ids, DataFrame):
        return chunks.join(document_ids.select("document_id").distinct(), "document_id", "left_anti")
    return chunks.where(~F.col("document_id").isin(list(document_ids)))


def embed_text(df: DataFrame, text: str, features: int = 256, output: str = "embedding", model: Column | None = None) -> DataFrame:
    """Hashed term frequency × inverse document frequency, unit length; pass a pandas_udf column as ``model`` to use another."""
    if model is not None:
        return df.withColumn(output, model.cast("array<float>"))
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD_BREAK, toLowercase=True).transform(df)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features).transform(words)
    tfidf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_idf", outputCol="_unit", p=2.0).transform(tfidf)
    return unit.withColumn(output, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


def metadata_condition(where: Mapping[str, str]) -> Column:
    cond = F.lit(True)
    for k, v in where.items():
        cond = cond & (F.try_element_at("metadata", F.lit(k)) == F.lit(v))
    return cond


def vector_topk(
    queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 0.2, where: Mapping[str, str] | None = None,
    metric: str = "sqeuclidean", counts: dict | None = None,
) -> DataFrame:
    """(query_id, document_id, chunk_id, distance, score, rank): exact nearest chunks of every query.

    The chunks are stored by cell and ring around centroids; all questions go through them in one pass and read only the rings that the triangle bound
    cannot shut out (``vectors.nearest``). score = 1 - d for d <= 1, else 1/d; scores below ``min_score`` are dropped. With ``cosine``, vectors of
    length 0 have no direction and are neither asked nor found.
    """
    from .vectors import nearest

    def unit(c: str) -> Column:
        wide = F.transform(F.col(c), lambda v: v.cast("double"))
        if metric != "cosine":
            return wide
        norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, v: a + v * v))
        return F.when(norm > 0, F.transform(wide, lambda v: v / norm))

    rows = chunks.where(metadata_condition(where)) if where else chunks
    rows = rows.select("document_id", "chunk_id", unit("embedding").alias("_v")).where("_v is not null")
    asked = cut_lineage(queries.select("query_id", unit("embedding").alias("_e")).where("_e is not null").withColumn("_q", F.monotonically_increasing_id()))
    found = nearest(asked.select("_q", "_e"), rows, k, counts).join(asked.select("_q", "query_id"), "_q")
    d = F.col("_dist")
    distance = {"cosine": d * d / 2, "euclidean": d}.get(metric, d * d)  # between unit vectors, 1 - cosine is half the squared distance
    w = Window.partitionBy("_q").orderBy("distance", "document_id", "chunk_id")
    ranked = found.withColumn("distance", distance).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    d = F.col("distance")
    scored = ranked.withColumn("score", F.when(d <= 1.0, 1.0 - d).otherwise(1.0 / d))
    return scored.where(F.col("score") >= min_score).select("query_id", "document_id", "chunk_id", "distance", "score", "rank")


def metadata_search(chunks: DataFrame, where: Mapping[str, str], limit: int = 10) -> DataFrame:
    """First ``limit`` chunks (by document and chunk id) whose metadata equals all given values."""
    return chunks.where(metadata_condition(where)).orderBy("document_id", "chunk_id").limit(limit)


def keyword_hit(query: str, content: str, metadata: str, fields: Sequence[str] | None = None) -> Column:
    """True when any word of the query occurs in the content or in the (given) metadata values."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), WORD_BREAK), lambda w: w != ""))
    values = F.map_values(metadata) if fields is None else F.array_compact(F.array(*[F.try_element_at(metadata, F.lit(f)) for f in fields]))
    hay = F.lower(F.concat_ws("\n", F.col(content), values))
    return F.exists(words, lambda w: hay.contains(w))


def with_content(found: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Retrieved rows with chunk content, metadata and query text."""
    full = found.join(chunks.select("document_id", "chunk_id", "content", "metadata"), ["document_id", "chunk_id"])
    return full.join(queries.select("query_id", F.col("text").alias("query")), "query_id")


def keyword_filter(found: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Of the retrieved chunks (``with_content``) those that hold a query word."""
    return found.where(keyword_hit("query", "content", "metadata", fields))


def hybrid_search(found: DataFrame, k: int = 5, weight: float = 0.3) -> DataFrame:
    """score·(1 - w) + w for a keyword hit; top ``k`` per query."""
    hit = keyword_hit("query", "content", "metadata").cast("int")
    mixed = found.withColumn("hybrid", F.col("score") * (1 - weight) + hit * F.lit(weight))
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "document_id", "chunk_id")
    return mixed.withColumn("hybrid_rank", F.row_number().over(w)).where(F.col("hybrid_rank") <= k)


def citation(metadata: str = "metadata") -> Column:
    get = lambda k: F.try_element_at(metadata, F.lit(k))
    source = F.coalesce(get("source"), F.lit("Unknown Source"))
    page = F.coalesce(F.concat(F.lit(" p."), get("page_num")), F.lit(""))
    return F.concat(F.coalesce(get("title"), source), F.lit(" ("), F.coalesce(get("author"), F.lit("Unknown Author")), F.lit(")"), page)


def context_pack(found: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """(query_id, documents, tokens, context): best chunks first with a citation line, up to the first that overflows."""
    text = F.concat(F.lit("Document: "), citation(), F.lit("\n\n"), F.col("content"))
    rows = found.withColumn("_text", text).withColumn("_tokens", F.floor(F.length("_text") / 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_id")  # k rows per query
    rows = rows.withColumn("_sum", F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(w))
    kept = rows.where(F.col("_sum") <= max_tokens)
    packed = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("_tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("_rank", "_text"))).alias("p"))
    return packed.select("query_id", "documents", "tokens", F.array_join(F.col("p._text"), RULE).alias("context"))


CONTEXT_INTRO = "Answer with the help of these passages from the literature:"
CONTEXT_OUTRO = "Name the document by its title when you use it. Where the passages do not help, say so and answer from general knowledge."


def augment_prompts(prompts: DataFrame, packs: DataFrame) -> DataFrame:
    """(query_id, prompt, system_prompt, context_used): the context is put into the system prompt; unchanged without one."""
    joined = prompts.join(packs.select("query_id", "context"), "query_id", "left")
    used = F.coalesce(F.length("context") > 0, F.lit(False))
    system = F.concat_ws("\n\n", F.col("system_prompt"), F.lit(CONTEXT_INTRO), F.col("context"), F.lit(CONTEXT_OUTRO))
    return joined.select("query_id", "prompt", F.when(used, system).otherwise(F.col("system_prompt")).alias("system_prompt"), used.alias("context_used"))
