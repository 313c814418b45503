"""Readers and writers for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: separators tried, in order
CSV_SEPARATORS = [",", ";", "\t", "|"]
TEXT_SEPARATORS = [",", "\t", ";", "|", " "]
FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet", "pq": "parquet"}


def _head(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(lines).collect() if r.value.strip()]


def _separator(lines: list[str], candidates: list[str]) -> str:
    """First separator that cuts every sampled line into the same number (more than one) of fields."""
    for sep in candidates:
        widths = {len(line.strip().split(sep)) for line in lines}
        if len(widths) == 1 and widths.pop() > 1:
            return sep
    for sep in candidates:
        if lines and sep in lines[0]:
            return sep
    return candidates[0]


def _read_separated(spark: SparkSession, path: str, sep: str, header: bool, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).option("nanValue", "NaN")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL everywhere in this package."""
    return df.select(
        *[
            F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def read_csv_sniffed(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """CSV whose separator is found from the first lines; give ``schema`` to avoid the type-inference scan."""
    return _read_separated(spark, path, _separator(_head(spark, path), CSV_SEPARATORS), header, schema)


def read_delimited_text(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """Text table (.txt, .dat, no extension) with any of the common separators."""
    return _read_separated(spark, path, _separator(_head(spark, path), TEXT_SEPARATORS), header, schema)


ORIENTS = ("auto", "lines", "records", "columns", "index", "split")


def read_json_oriented(
    spark: SparkSession, path: str, orient: str = "auto", schema: T.StructType | None = None, documents: str = "file"
) -> DataFrame:
    """JSON tables: ``lines`` (one record per line, splittable), ``records`` (array of objects), ``columns``, ``index``, ``split``.

    ``auto`` finds the form: lines from the first lines of the text, the others document by document from the value (``json_tables``), so one folder may hold
    several. A document cannot be cut, so each *file* is one task, or with ``documents="line"`` each line holds a document. Cells come back as strings
    unless ``schema`` is given.
    """
    if orient not in ORIENTS or documents not in ("file", "line"):
        raise ValueError(f"unknown orient or documents: {orient}, {documents}")
    if orient == "lines" or (orient == "auto" and documents == "file" and _is_lines(spark, path)):
        reader = spark.read.option("mode", "PERMISSIVE")
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if orient == "records" and documents == "file":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    return json_tables(spark.read.text(path, wholetext=documents == "file"), "value", orient, schema)


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Two lines or more, each of the first ones an object of its own."""
    lines = _head(spark, path)
    if len(lines) < 2:
        return False
    found = spark.createDataFrame([(line,) for line in lines], "line string").select(F.try_variant_get(F.try_parse_json("line"), "$", "map<string,variant>").alias("o"))
    return found.where("o is null").isEmpty()


def json_shape(document: Column) -> Column:
    """The form of a table in a Variant: records, split, columns, index, lists (an object of arrays), record (a single object), or null for anything else.

    Objects of objects are read by columns, unless only the outer keys are row numbers.
    """
    rows, parts = F.try_variant_get(document, "$", "array<map<string,variant>>"), F.try_variant_get(document, "$", "map<string,variant>")
    nested, lists = F.try_variant_get(document, "$", "map<string,map<string,variant>>"), F.try_variant_get(document, "$", "map<string,array<variant>>")
    known = lambda values: F.forall(values, lambda v: v.isNotNull())  # noqa: E731 - what does not fit a type inside is null
    number = lambda k: k.rlike(r"^-?\d+$")
    by_row = F.forall(F.map_keys(nested), number) & ~F.forall(F.flatten(F.transform(F.map_values(nested), lambda m: F.map_keys(m))), number)
    return (
        F.when(known(rows), "records")
        .when(F.try_variant_get(document, "$.columns", "array<string>").isNotNull() & F.try_variant_get(document, "$.data", "array<array<variant>>").isNotNull(), "split")
        .when((F.size(nested) > 0) & known(F.map_values(nested)), F.when(by_row, "index").otherwise("columns"))
        .when((F.size(lists) > 0) & known(F.map_values(lists)), "lists")
        .when(parts.isNotNull(), "record")
    )


def json_cells(documents: DataFrame, column: str, orient: str = "auto") -> DataFrame:
    """(_document, row, column, cell): every cell of the tables in ``documents``, one JSON text each; texts of no known form give none."""
    doc = documents.select(F.monotonically_increasing_id().alias("_document"), F.try_parse_json(column).alias("v"))
    doc = doc.select("_document", "v", (json_shape(F.col("v")) if orient == "auto" else F.lit(orient)).alias("shape"))
    cell = "struct<row:string,column:string,cell:string>"

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("v", path, kind)

    def entries(of: Column, make) -> Column:
        return F.transform(F.map_entries(of), make)

    def struct(row: Column, name: Column, value: Column) -> Column:
        return F.struct(row.cast("string").alias("row"), name.alias("column"), value.alias("cell"))

    strings, rows = "map<string,string>", get("$", "array<map<string,string>>")
    outer = get("$", "map<string,map<string,string>>")
    names = get("$.columns", "array<string>")
    found = (
        F.when(F.col("shape") == "records", F.flatten(F.transform(rows, lambda r, i: entries(r, lambda e: struct(i, e["key"], e["value"])))))
        .when(F.col("shape") == "split", F.flatten(F.transform(get("$.data", "array<array<string>>"), lambda r, i: F.transform(names, lambda n, j: struct(i, n, F.get(r, j))))))
        .when(F.col("shape") == "columns", F.flatten(entries(outer, lambda o: entries(o["value"], lambda e: struct(e["key"], o["key"], e["value"])))))
        .when(F.col("shape") == "index", F.flatten(entries(outer, lambda o: entries(o["value"], lambda e: struct(o["key"], e["key"], e["value"])))))
        .when(F.col("shape") == "lists", F.flatten(entries(get("$", "map<string,array<string>>"), lambda o: F.transform(o["value"], lambda x, i: struct(i, o["key"], x)))))
        .when(F.col("shape") == "record", entries(get("$", strings), lambda e: struct(F.lit(0), e["key"], e["value"])))
        .otherwise(F.array().cast(f"array<{cell}>"))
    )
    return doc.select("_document", F.inline(found))


def json_tables(documents: DataFrame, column: str, orient: str = "auto", schema: T.StructType | None = None) -> DataFrame:
    """The rows of all tables in ``documents`` in one pass; a column that a table lacks is null. Columns come from ``schema``, or by name from the documents."""
    cells = json_cells(documents, column, orient)
    names = schema.names if schema is not None else [r[0] for r in cells.select("column").distinct().orderBy("column").collect()]  # columns of a table
    wide = cells.groupBy("_document", "row").pivot("column", names).agg(F.first("cell", ignorenulls=True))
    return wide.select(*[_typed(F.col(f"`{c}`"), c, schema) for c in names])


def _typed(col, name: str, schema: T.StructType | None):
    return (col.cast(schema[name].dataType) if schema is not None else col).alias(name)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows, missing count, any-missing flag; one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
            F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"_n{i}")).alias("missing"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows))).withColumn("has_missing", F.col("missing") > 0)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Save as csv, json or parquet (format from the extension unless given); returns (path, format, rows, bytes).

    One job: the rows are observed while they are written, nothing is read back. ``bytes`` is the size of the files in the folder, from their listing.
    """
    spark = df.sparkSession
    kind = fmt or FORMATS.get(path.rsplit(".", 1)[-1].lower())
    if kind not in set(FORMATS.values()):
        raise ValueError(f"cannot tell the format of {path}")
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(
        F.lit(path).alias("path"), F.lit(kind).alias("format"), F.lit(seen.get["rows"]).cast("long").alias("rows"), "bytes"
    )


def coerce_numeric(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Number when every value parses, otherwise 0-based codes of the sorted distinct values."""
    from ..operators.scaling import category_codes

    parsed = F.expr(f"try_cast(trim(`{column}`) AS double)")
    bad = df.agg(F.count(F.when(F.col(column).isNotNull() & parsed.isNull(), 1)).alias("b")).first().b
    name = output or column
    if not bad:
        return df.withColumn(name, parsed)
    return category_codes(df, column, name).withColumn(name, F.col(name).cast("double"))
