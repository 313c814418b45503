"""Tables of relational databases over JDBC, and listings of what a database or session holds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: JDBC url pattern and driver class per kind of database
KINDS = {
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
}


def connection_options(kind: str, database: str, host: str = "localhost", port: int | None = None, **props: str) -> dict:
    """Reader options for a kind of database, or pass a full JDBC url as ``kind``."""
    if kind.startswith("jdbc:"):
        return {"url": kind, **props}
    pattern, driver = KINDS[kind]
    ports = {"mysql": 3306, "postgresql": 5432}
    return {"url": pattern.format(host=host, port=port or ports.get(kind), database=database), "driver": driver, **props}


def jdbc_table(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    limit: int | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A table, read by ``partitions`` tasks on ranges of ``partition_column``; filters, columns and limit push down."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column:
        lower, upper = bounds or jdbc_bounds(spark, options, table, partition_column)
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
            numPartitions=partitions or spark.sparkContext.defaultParallelism,
        )
    df = reader.load()
    return df if limit is None else df.limit(limit)


def jdbc_bounds(spark: SparkSession, options: Mapping[str, str], table: str, column: str) -> tuple[str, str]:
    row = jdbc_query(spark, options, f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}").first()
    return str(row[0]), str(row[1])


def jdbc_query(spark: SparkSession, options: Mapping[str, str], text: str) -> DataFrame:
    """Result of a query that the remote database runs."""
    return spark.read.format("jdbc").options(**options).option("query", text).load()


def view_query(tables: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Result of a SQL text over DataFrames given by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text)


def jdbc_listing(spark: SparkSession, options: Mapping[str, str], schema: str) -> DataFrame:
    cols = jdbc_query(
        spark, options,
        "SELECT table_name, column_name, data_type, ordinal_position FROM information_schema.columns "
        f"WHERE table_schema = '{schema}'",
    ).toDF("table", "name", "type", "position")
    return listing_rows(cols)


def listing_rows(cols: DataFrame) -> DataFrame:
    """(table, columns, types) from one row per column."""
    packed = F.array_sort(F.collect_list(F.struct("position", "name", "type")))
    return cols.groupBy("table").agg(packed.alias("c")).select("table", F.col("c.name").alias("columns"), F.col("c.type").alias("types"))


def catalog_listing(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, columns, types, rows) of named DataFrames; the row counts are one union job."""
    parts = []
    for name, df in tables.items():
        types = F.array(*[F.lit(t) for _, t in df.dtypes])
        names = F.array(*[F.lit(c) for c in df.columns])
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), names.alias("columns"), types.alias("types"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
