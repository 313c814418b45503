"""Sources, sinks, projection, filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...functions.lineage import checkpoint_dir
from ...operators import reshape
from ...sources import databases, files, runlog
from ..registry import load, query, rounded, rounded_sql
from ..steps import run_steps


def scratch(spark, name: str) -> str:
    """A new folder beside the checkpoints, in storage that every executor reaches."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


def _orders(spark, sf):
    return load(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query("read_csv_sniffed", ORDERS_SQL)
def read_csv_sniffed(spark, sf):
    path, df = scratch(spark, "csv"), _orders(spark, sf)
    df.write.option("header", True).option("sep", ";").csv(path)
    return files.read_csv_sniffed(spark, path, schema=df.schema)


@query("read_delimited_text", ORDERS_SQL)
def read_delimited_text(spark, sf):
    path, df = scratch(spark, "txt"), _orders(spark, sf)
    df.write.option("header", True).option("sep", "\t").csv(path)
    return files.read_delimited_text(spark, path, schema=df.schema)


@query("read_json_oriented", ORDERS_SQL)
def read_json_oriented(spark, sf):
    path, df = scratch(spark, "json"), _orders(spark, sf)
    df.write.json(path)
    return files.read_json_oriented(spark, path, "lines", df.schema)


@query("read_json_shapes", ORDERS_SQL)
def read_json_shapes(spark, sf):
    """Orders as one JSON table per twenty customers, in turn as records, columns, index, split and arrays; the reader finds each form."""
    df, path = _orders(spark, sf), scratch(spark, "json")
    text = F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])
    group = F.floor(F.col("o_custkey") / 20)
    tables = df.groupBy(group.alias("g")).agg(F.collect_list(F.struct(*df.columns)).alias("rows"), F.collect_list(text).alias("texts"))
    each = lambda make: F.map_from_entries(F.transform("texts", lambda r, i: F.struct(i.cast("string").alias("k"), make(r).alias("v"))))
    cell = lambda c: lambda r: r[c]
    shapes = [
        F.to_json("rows"),
        F.to_json(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), each(cell(c)).alias("v")) for c in df.columns]))),
        F.to_json(each(lambda r: r)),
        F.to_json(F.struct(F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.transform("texts", lambda r: F.array(*[r[c] for c in df.columns])).alias("data"))),
        F.to_json(F.struct(*[F.transform("texts", cell(c)).alias(c) for c in df.columns])),
    ]
    form = shapes[-1]
    for k, s in enumerate(shapes[:-1]):
        form = F.when(F.col("g") % len(shapes) == k, s).otherwise(form)
    tables.select(form.alias("value")).write.text(path)
    return files.read_json_oriented(spark, path, schema=df.schema, documents="line")


@query("read_parquet", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def read_parquet(spark, sf):
    return files.read_parquet(spark, f"{sf}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _meta_sql() -> str:
    cols = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"), ("quality", "int")]
    src = "(SELECT o.*, l.quality FROM orders o LEFT JOIN labels l ON l.doc_id = o.o_orderkey)"
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS missing, "
        f"count(*) > count({c}) AS has_missing FROM {src}"
        for i, (c, t) in enumerate(cols)
    )


@query("dataset_metadata", _meta_sql())
def dataset_metadata(spark, sf):
    labels = load(spark, sf, "labels").select(F.col("doc_id").alias("o_orderkey"), "quality")
    return files.dataset_metadata(load(spark, sf, "orders").join(labels, "o_orderkey", "left"))


@query("view_query", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def view_query(spark, sf):
    tables = {"orders_v": load(spark, sf, "orders"), "customer_v": load(spark, sf, "customer")}
    return databases.view_query(tables, "SELECT c_mktsegment, count(*) AS n FROM orders_v JOIN customer_v ON o_custkey = c_custkey GROUP BY 1")


@query(
    "catalog_listing",
    """SELECT 'orders' AS "table", ['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority'] AS columns,
    ['bigint','bigint','string','double','timestamp_ntz','string'] AS types, count(*) AS rows FROM orders
    UNION ALL SELECT 'events', ['event_id','ts','user_id','event_type','value','props'],
    ['bigint','timestamp_ntz','bigint','string','double','string'], count(*) FROM events""",
)
def catalog_listing(spark, sf):
    return databases.catalog_listing({t: load(spark, sf, t) for t in ("orders", "events")})


@query("write_table", "SELECT 'parquet' AS format, count(*) AS rows FROM lineitem UNION ALL SELECT 'csv', count(*) FROM orders UNION ALL SELECT 'json', count(*) FROM customer")
def write_table(spark, sf):
    parts = [
        files.write_table(load(spark, sf, t), scratch(spark, "out"), fmt)
        for t, fmt in (("lineitem", "parquet"), ("orders", "csv"), ("customer", "json"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("format", "rows")


@query(
    "coerce_numeric",
    """WITH codes AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS c FROM (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS cust, CAST(c AS DOUBLE) AS prio FROM orders JOIN codes USING (o_orderpriority)""",
)
def coerce_numeric(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderpriority").alias("prio"))
    return files.coerce_numeric(files.coerce_numeric(df, "cust"), "prio")


def _runs(spark, sf):
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("algorithm"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("execution_time"), F.col("o_orderdate").alias("created_at"),
    )


@query(
    "run_catalog_append",
    rounded_sql(
        """WITH e AS (SELECT l_orderkey AS run_id, l_partkey AS src, l_suppkey AS dst FROM lineitem),
    ends AS (SELECT run_id, src AS node FROM e UNION SELECT run_id, dst FROM e),
    n AS (SELECT run_id, count(*) AS c FROM ends GROUP BY 1), m AS (SELECT run_id, count(*) AS c FROM e GROUP BY 1)
    SELECT o_orderkey AS run_id, o_orderstatus AS status, o_totalprice AS execution_time, coalesce(n.c, 0) AS nodes_count, coalesce(m.c, 0) AS edges_count
    FROM orders LEFT JOIN n ON n.run_id = o_orderkey LEFT JOIN m ON m.run_id = o_orderkey""",
        "run_id status nodes_count edges_count", "execution_time"),
)
def run_catalog_append(spark, sf):
    root = scratch(spark, "runs")
    edges = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    runlog.append_graph(_runs(spark, sf), edges, root)
    return rounded(runlog.read(spark, root, "runs").select("run_id", "status", "execution_time", "nodes_count", "edges_count"))


@query(
    "run_catalog_recent",
    """SELECT o_orderkey AS run_id, o_orderpriority AS algorithm, o_orderstatus AS status, o_totalprice AS execution_time, o_orderdate AS created_at
    FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5""",
)
def run_catalog_recent(spark, sf):
    return runlog.recent(_runs(spark, sf), 5)


@query(
    "run_statistics",
    rounded_sql("""SELECT o_custkey AS run_id, o_orderstatus AS status, count(*) AS steps, sum(o_totalprice) AS total_time, max(o_totalprice) AS slowest
    FROM orders GROUP BY 1, 2""", "run_id status steps", "total_time slowest", 2),
)
def run_statistics(spark, sf):
    steps = load(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("execution_time"))
    return rounded(runlog.statistics(steps), 2)


@query(
    "filter_conditions",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, nullif(l_discount, 0) AS disc FROM lineitem
    WHERE l_quantity >= 10 AND l_quantity < 45 AND l_extendedprice > 5000 AND l_tax <= 0.06
    AND coalesce(nullif(l_discount, 0) <> 0.05, true) AND l_returnflag IN ('A', 'R') AND coalesce(nullif(l_discount, 0) NOT IN (0.01, 0.1), true) AND l_linestatus = 'F'""",
)
def filter_conditions(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("disc", F.expr("nullif(l_discount, 0)"))
    spec = [("l_quantity", ">=", 10), ("l_quantity", "<", 45), ("l_extendedprice", ">", 5000), ("l_tax", "<=", 0.06), ("disc", "!=", 0.05),
            ("l_returnflag", "in", ["A", "R"]), ("disc", "not in", [0.01, 0.1]), ("l_linestatus", "==", "F")]
    out = reshape.filter_conditions(df, [{"column": c, "operator": o, "value": v} for c, o, v in spec])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "disc")


@query("select_columns", "SELECT l_orderkey, l_returnflag, l_tax FROM lineitem")
def select_columns(spark, sf):
    return reshape.select_columns(load(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag", "l_tax"])


@query(
    "collapse_categories",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' WHEN '5-LOW' THEN 'slow' ELSE o_orderpriority END AS speed,
    count(*) AS n FROM orders GROUP BY 1""",
)
def collapse_categories(spark, sf):
    mapping = {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"}
    out = reshape.collapse_categories(load(spark, sf, "orders"), "o_orderpriority", mapping, "speed")
    return out.groupBy("speed").agg(F.count(F.lit(1)).alias("n"))


def _detect_sql() -> str:
    texts, nums = ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    parts = [f"SELECT '{c}' AS \"column\", 'text' AS reason, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in texts]
    parts += [f"SELECT '{c}', 'few_values', count(DISTINCT {c}) FROM lineitem HAVING count(DISTINCT {c}) <= 10 AND count(DISTINCT {c}) < 0.05 * count(*)" for c in nums]
    return " UNION ALL ".join(parts)


@query("detect_categorical", _detect_sql())
def detect_categorical(spark, sf):
    return reshape.detect_categorical(load(spark, sf, "lineitem"))


@query(
    "group_columns_by_kind",
    """SELECT 'doc_id' AS "column", 'numeric' AS kind UNION ALL SELECT 'text', 'categorical' UNION ALL SELECT 'lang', 'categorical' UNION ALL SELECT 'source', 'categorical'
    UNION ALL SELECT 'n_chars', (SELECT CASE WHEN bool_and(n_chars IN (0, 1)) THEN 'boolean' ELSE 'numeric' END FROM documents)
    UNION ALL SELECT 'quality', (SELECT CASE WHEN bool_and(quality IN (0, 1)) THEN 'boolean' ELSE 'numeric' END FROM labels)
    UNION ALL SELECT 'toxic', (SELECT CASE WHEN bool_and(toxic IN (0, 1)) THEN 'boolean' ELSE 'numeric' END FROM labels)""",
)
def group_columns_by_kind(spark, sf):
    df = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return reshape.group_columns_by_kind(df)


@query(
    "step_spec",
    rounded_sql("""WITH f AS (SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O', 'P')),
    s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM f)
    SELECT o_orderkey, (o_totalprice - m) / d AS o_totalprice, CASE WHEN o_orderpriority = '5-LOW' THEN '4-NOT SPECIFIED' ELSE o_orderpriority END AS o_orderpriority,
    year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM f, s""",
                "o_orderkey o_orderpriority year month", "o_totalprice"),
)
def step_spec(spark, sf):
    spec = [
        {"type": "filter_conditions", "conditions": [{"column": "o_totalprice", "operator": ">", "value": 1000}, {"column": "o_orderstatus", "operator": "in", "value": ["F", "O", "P"]}]},
        {"type": "scale_standard", "columns": ["o_totalprice"]},
        {"type": "collapse_categories", "column": "o_orderpriority", "mapping": {"5-LOW": "4-NOT SPECIFIED"}},
        {"type": "time_features", "ts": "o_orderdate", "parts": ["year", "month"]},
        {"type": "select_columns", "columns": ["o_orderkey", "o_totalprice", "o_orderpriority", "year", "month"]},
    ]
    return rounded(run_steps(load(spark, sf, "orders"), spec)[0])
