"""Missing values, scaling, encoding, binning, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import missing, outliers, scaling
from ..registry import load, query, rounded, rounded_sql

HOLES = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_discount, 0) AS disc, nullif(l_tax, 0) AS tax,
CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN NULL ELSE l_quantity END AS qty, nullif(l_returnflag, 'N') AS flag, l_extendedprice AS price FROM lineitem)"""


def holes(spark, sf):
    """Line items where zero discount and tax, flag N and large returned quantities count as missing."""
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.expr("nullif(l_discount, 0)").alias("disc"), F.expr("nullif(l_tax, 0)").alias("tax"),
        F.expr("CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN NULL ELSE l_quantity END").alias("qty"),
        F.expr("nullif(l_returnflag, 'N')").alias("flag"), F.col("l_extendedprice").alias("price"),
    )


KEYS = "l_orderkey l_partkey l_suppkey l_linenumber"


def _missing_sql() -> str:
    cols = ["disc", "tax", "qty", "flag", "price"]
    total = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS percent, "
        f"({total}) * 100.0::DOUBLE / (count(*) * {len(cols)}) AS overall_percent FROM {HOLES}"
        for c in cols
    )


@query("missing_profile", rounded_sql(_missing_sql(), '"column" missing', "percent overall_percent"))
def missing_profile(spark, sf):
    return rounded(missing.missing_profile(holes(spark, sf).select("disc", "tax", "qty", "flag", "price")))


@query("dropna", f"SELECT l_orderkey, l_linenumber, disc, tax, qty, flag FROM {HOLES} WHERE disc IS NOT NULL AND tax IS NOT NULL AND qty IS NOT NULL AND flag IS NOT NULL")
def dropna(spark, sf):
    return missing.dropna(holes(spark, sf)).select("l_orderkey", "l_linenumber", "disc", "tax", "qty", "flag")


@query(
    "impute_mean_median",
    rounded_sql(f"""WITH h AS (SELECT * FROM {HOLES}), s AS (SELECT avg(disc) AS d, median(qty) AS q FROM h)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(disc, d) AS disc, coalesce(qty, q) AS qty FROM h, s""", KEYS, "disc qty"),
)
def impute_mean_median(spark, sf):
    df = missing.impute_mean_median(holes(spark, sf), ["disc"], "mean")
    return rounded(missing.impute_mean_median(df, ["qty"], "median").select(*KEYS.split(), "disc", "qty"))


@query(
    "impute_mode_constant",
    f"""WITH h AS (SELECT * FROM {HOLES}),
    f AS (SELECT flag AS v FROM h WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    d AS (SELECT disc AS v FROM h WHERE disc IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, coalesce(flag, f.v) AS flag, coalesce(disc, d.v) AS disc, coalesce(tax, -1.0::DOUBLE) AS tax FROM h, f, d""",
)
def impute_mode_constant(spark, sf):
    df = missing.impute_mode_constant(holes(spark, sf), ["flag", "disc"])
    return missing.impute_mode_constant(df, ["tax"], -1.0).select("l_orderkey", "l_linenumber", "flag", "disc", "tax")


EVENTS_HOLES = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS v FROM events)"


def events_holes(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", F.when(~F.col("event_type").isin("error", "view"), F.col("value")).alias("v")
    )


@query(
    "fill_forward_backward",
    f"""SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS fwd,
    coalesce(v, first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bwd FROM {EVENTS_HOLES}""",
)
def fill_forward_backward(spark, sf):
    df = events_holes(spark, sf)
    fwd = missing.fill_forward_backward(df, ["v"], ["ts", "event_id"], ["user_id"], "ffill").select("event_id", F.col("v").alias("fwd"))
    bwd = missing.fill_forward_backward(df, ["v"], ["ts", "event_id"], [], "bfill").select("event_id", F.col("v").alias("bwd"))
    return fwd.join(bwd, "event_id")


@query(
    "interpolate_time",
    rounded_sql(f"""WITH e AS (SELECT *, CASE WHEN v IS NOT NULL THEN ts END AS kt FROM {EVENTS_HOLES}),
    w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(kt IGNORE NULLS) OVER p AS pt,
      first_value(v IGNORE NULLS) OVER n AS nv, first_value(kt IGNORE NULLS) OVER n AS nt FROM e
      WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      n AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, user_id, CASE WHEN v IS NOT NULL THEN v WHEN nv IS NULL THEN pv
      ELSE pv + (nv - pv) * (epoch_us(ts) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt)) END AS v FROM w""", "event_id user_id", "v"),
)
def interpolate_time(spark, sf):
    return rounded(missing.interpolate_time(events_holes(spark, sf), ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "v"))


@query("missingness_type")
def missingness_type(spark, sf):
    return missing.missingness_type(holes(spark, sf), ["disc", "tax", "qty", "flag", "price"])


@query(
    "impute_knn",
    rounded_sql("""WITH o AS (SELECT o_custkey, avg(o_totalprice) AS spend, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1),
    t AS (SELECT c_custkey, c_acctbal, spend, n_orders FROM customer LEFT JOIN o ON c_custkey = o_custkey),
    d AS (SELECT q.c_custkey, p.spend, p.n_orders, sqrt(power(p.c_acctbal - q.c_acctbal, 2) * 3) AS dist FROM t q JOIN t p ON q.spend IS NULL AND p.spend IS NOT NULL),
    s AS (SELECT c_custkey, avg(spend) AS spend FROM (FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, spend) <= 5) GROUP BY 1),
    n AS (SELECT c_custkey, avg(n_orders) AS n_orders FROM (FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, n_orders) <= 5) GROUP BY 1)
    SELECT t.c_custkey, c_acctbal, coalesce(t.spend, s.spend) AS spend, coalesce(t.n_orders, n.n_orders) AS n_orders FROM t LEFT JOIN s USING (c_custkey) LEFT JOIN n USING (c_custkey)""",
                "c_custkey", "c_acctbal spend n_orders", 4),
)
def impute_knn(spark, sf):
    df = load(spark, sf, "customer").join(
        load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n_orders")),
        "c_custkey", "left",
    )
    return rounded(missing.impute_knn(df.select("c_custkey", "c_acctbal", "spend", "n_orders"), ["c_acctbal", "spend", "n_orders"], "c_custkey"), 4)


@query("impute_regression")
def impute_regression(spark, sf):
    df = holes(spark, sf).select(*KEYS.split(), "price", "qty", "flag")
    num = missing.impute_regression(df, "qty", ["price", "l_linenumber"])
    return rounded(missing.impute_regression(num, "flag", ["price", "qty"]), 4)


@query("impute_causal")
def impute_causal(spark, sf):
    df = holes(spark, sf).select(*KEYS.split(), "price", "qty", "disc", "tax")
    return rounded(missing.impute_causal(df, [("price", "qty"), ("qty", "disc"), ("disc", "tax"), ("price", "tax")], ["price", "qty", "disc", "tax"]), 4)


@query("impute_multiple")
def impute_multiple(spark, sf):
    df = holes(spark, sf).select(*KEYS.split(), "price", "qty", "disc").withColumn("row_key", F.xxhash64(*KEYS.split(), "price"))
    return missing.impute_multiple(df, "row_key", ["price", "qty", "disc"])


NUMS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scale_sql(centre: str, width: str) -> str:
    stats = ", ".join(f"{centre.format(c=c)} AS m_{c}, {width.format(c=c)} AS s_{c}" for c in NUMS)
    cols = ", ".join(f"(l.{c} - m_{c}) / s_{c} AS {c}" for c in NUMS)
    return rounded_sql(f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_partkey, l_linenumber, {cols} FROM lineitem l, s", "l_orderkey l_partkey l_linenumber", " ".join(NUMS))


def _scaled(df):
    return rounded(df.select("l_orderkey", "l_partkey", "l_linenumber", *NUMS))


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf):
    return _scaled(scaling.scale_standard(load(spark, sf, "lineitem"), NUMS))


@query("scale_minmax", _scale_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, sf):
    return _scaled(scaling.scale_minmax(load(spark, sf, "lineitem"), NUMS))


@query("scale_robust", _scale_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scale_robust(spark, sf):
    return _scaled(scaling.scale_robust(load(spark, sf, "lineitem"), NUMS))


@query(
    "encode_onehot",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INT AS "o_orderstatus_F", (o_orderstatus = 'O')::INT AS "o_orderstatus_O", (o_orderstatus = 'P')::INT AS "o_orderstatus_P",
    (o_orderpriority = '2-HIGH')::INT AS "o_orderpriority_2-HIGH", (o_orderpriority = '3-MEDIUM')::INT AS "o_orderpriority_3-MEDIUM",
    (o_orderpriority = '4-NOT SPECIFIED')::INT AS "o_orderpriority_4-NOT SPECIFIED", (o_orderpriority = '5-LOW')::INT AS "o_orderpriority_5-LOW" FROM orders""",
)
def encode_onehot(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return scaling.encode_onehot(scaling.encode_onehot(df, ["o_orderstatus"]), ["o_orderpriority"], drop_first=True)


@query(
    "encode_label",
    """WITH a AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS p_brand_label FROM (SELECT DISTINCT p_brand FROM part)),
    b AS (SELECT p_name, (row_number() OVER (ORDER BY p_name) - 1)::INT AS p_name_label FROM (SELECT DISTINCT p_name FROM part))
    SELECT p_partkey, p_brand_label, p_name_label FROM part JOIN a USING (p_brand) JOIN b USING (p_name)""",
)
def encode_label(spark, sf):
    return scaling.encode_label(load(spark, sf, "part"), ["p_brand", "p_name"]).select("p_partkey", "p_brand_label", "p_name_label")


@query(
    "encode_ordinal",
    """WITH f AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY min((o_orderdate, o_orderkey)), o_orderpriority) - 1)::INT AS k FROM orders GROUP BY 1)
    SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS status_code, k AS priority_code FROM orders JOIN f USING (o_orderpriority)""",
)
def encode_ordinal(spark, sf):
    df = scaling.encode_ordinal(load(spark, sf, "orders"), "o_orderstatus", ["O", "P", "F"], output="status_code")
    return scaling.encode_ordinal(df, "o_orderpriority", order_col=["o_orderdate", "o_orderkey"], output="priority_code").select("o_orderkey", "status_code", "priority_code")


@query(
    "bin_uniform",
    """WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
    SELECT p_partkey, (p_retailprice > lo + (hi - lo) * 1 / 5)::INT + (p_retailprice > lo + (hi - lo) * 2 / 5)::INT + (p_retailprice > lo + (hi - lo) * 3 / 5)::INT
    + (p_retailprice > lo + (hi - lo) * 4 / 5)::INT AS p_retailprice_binned FROM part, s""",
)
def bin_uniform(spark, sf):
    return scaling.bin_uniform(load(spark, sf, "part"), "p_retailprice", 5).select("p_partkey", "p_retailprice_binned")


@query(
    "bin_quantile",
    """WITH s AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity, ['low', 'mid', 'high', 'top'][1 + (l_quantity > q[1])::INT + (l_quantity > q[2])::INT + (l_quantity > q[3])::INT] AS l_quantity_binned FROM lineitem, s""",
)
def bin_quantile(spark, sf):
    out = scaling.bin_quantile(load(spark, sf, "lineitem"), "l_quantity", 4, ["low", "mid", "high", "top"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_quantity_binned")


@query("bin_kmeans")
def bin_kmeans(spark, sf):
    out = scaling.bin_kmeans(load(spark, sf, "orders"), "o_totalprice", 4)
    return out.groupBy("o_totalprice_binned").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query(
    "group_codes",
    """WITH c AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS group_code FROM (SELECT DISTINCT event_type FROM events)),
    s AS (SELECT min(ts) AS lo, count(*) AS n FROM events)
    SELECT event_id, group_code, CASE WHEN n < 4 THEN 3 ELSE least((row_number() OVER (ORDER BY ts, event_id) - 1) // (n // 4), 3) END::INT AS segment,
    floor(date_diff('day', lo, ts) / 7)::INT AS period FROM events JOIN c USING (event_type), s""",
)
def group_codes(spark, sf):
    df = scaling.group_codes(load(spark, sf, "events"), "event_type")
    df = scaling.period_codes(scaling.segments(df, ["ts", "event_id"], 4), "ts")
    return df.select("event_id", "group_code", "segment", "period")


@query(
    "outlier_zscore",
    """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events)
    SELECT event_id, value, abs(value - m) / d > 2.5 AS value_is_outlier FROM events, s""",
)
def outlier_zscore(spark, sf):
    return outliers.outlier_zscore(load(spark, sf, "events"), ["value"], 2.5).select("event_id", "value", "value_is_outlier")


@query(
    "outlier_iqr",
    rounded_sql("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS value_is_outlier, a - 1.5 * (b - a) AS value_lower, b + 1.5 * (b - a) AS value_upper FROM events, q""",
                "event_id value_is_outlier", "value_lower value_upper"),
)
def outlier_iqr(spark, sf):
    return rounded(outliers.outlier_iqr(load(spark, sf, "events"), ["value"]).select("event_id", "value_is_outlier", "value_lower", "value_upper"))


@query(
    "outlier_remove_rows",
    """WITH z AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events), k AS (SELECT * FROM events, z WHERE abs(value - m) / d <= 2.0),
    q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM k)
    SELECT event_id, value FROM k, q WHERE value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a)""",
)
def outlier_remove_rows(spark, sf):
    df = outliers.outlier_remove_rows(load(spark, sf, "events"), ["value"], "zscore", 2.0)
    return outliers.outlier_remove_rows(df, ["value"], "iqr", 1.5).select("event_id", "value")


@query(
    "outlier_replace",
    rounded_sql("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, stddev_samp(value) AS ds, median(value) AS med, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, CASE WHEN abs(value - m) / d > 2 THEN least(greatest(value, m - 2 * ds), m + 2 * ds) ELSE value END AS clipped,
    CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN med ELSE value END AS by_median,
    CASE WHEN abs(value - m) / d > 2 THEN m ELSE value END AS by_mean FROM events, s""", "event_id", "clipped by_median by_mean"),
)
def outlier_replace(spark, sf):
    df = load(spark, sf, "events").select("event_id", F.col("value").alias("clipped"), F.col("value").alias("by_median"), F.col("value").alias("by_mean"))
    df = outliers.outlier_replace(df, ["clipped"], "zscore", 2.0, "clip")
    df = outliers.outlier_replace(df, ["by_median"], "iqr", 1.5, "median")
    return rounded(outliers.outlier_replace(df, ["by_mean"], "zscore", 2.0, "mean"))


def _summary_sql() -> str:
    def one(t, c):
        return f"""SELECT '{c}' AS "column", count(CASE WHEN abs({c} - m) / d > 3 THEN 1 END) AS z_count,
        count(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 END) AS iqr_count, count(*) AS n, any_value(a - 1.5 * (b - a)) AS lower, any_value(b + 1.5 * (b - a)) AS upper
        FROM {t}, (SELECT avg({c}) AS m, stddev_pop({c}) AS d, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t})"""
    src = "(SELECT value, user_id, value * value AS square, CASE WHEN value > 10 THEN value ELSE -value * 3 END AS bent FROM events)"
    body = " UNION ALL ".join(one(src, c) for c in ("value", "user_id", "square", "bent"))
    return rounded_sql(f"""WITH u AS ({body}), k AS (SELECT *, iqr_count * 100.0::DOUBLE / n AS percent FROM u WHERE z_count > 0 AND iqr_count > 0 AND iqr_count * 100.0 / n > 0.1)
    SELECT "column", z_count, iqr_count, percent, lower, upper, (SELECT sum(iqr_count) * 100.0::DOUBLE / sum(n) FROM k) AS overall_percent FROM k""",
                       '"column" z_count iqr_count', "percent lower upper overall_percent", 4)


@query("outlier_summary", _summary_sql())
def outlier_summary(spark, sf):
    df = load(spark, sf, "events").select("value", "user_id", (F.col("value") * F.col("value")).alias("square"), F.when(F.col("value") > 10, F.col("value")).otherwise(-F.col("value") * 3).alias("bent"))
    return rounded(outliers.outlier_summary(df, ["value", "user_id", "square", "bent"]), 4)


@query("outlier_isolation_forest")
def outlier_isolation_forest(spark, sf):
    out = outliers.outlier_isolation_forest(load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], "o_orderkey", 0.05)
    return rounded(out)


@query(
    "outlier_dbscan",
    """WITH e AS (SELECT event_id, value, hour(ts)::DOUBLE AS hour FROM events), s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(hour) AS mh, stddev_pop(hour) AS sh FROM e),
    z AS (SELECT event_id, value, hour, (value - mv) / sv AS x, (hour - mh) / sh AS y FROM e, s),
    n AS (SELECT a.event_id, b.event_id AS other FROM z a JOIN z b ON b.y BETWEEN a.y - 0.3 AND a.y + 0.3 AND b.x BETWEEN a.x - 0.3 AND a.x + 0.3 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.3::DOUBLE * 0.3::DOUBLE),
    core AS (SELECT event_id FROM n GROUP BY 1 HAVING count(*) >= 5)
    SELECT event_id, value, hour, event_id NOT IN (SELECT n.event_id FROM n JOIN core c ON c.event_id = n.other) AS is_outlier FROM z""",
)
def outlier_dbscan(spark, sf):
    df = load(spark, sf, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    return outliers.outlier_dbscan(df, ["value", "hour"], "event_id", eps=0.3)
