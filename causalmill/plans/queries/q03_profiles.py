"""Profiling aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import profile
from ..registry import load, query, rounded, rounded_sql

TYPES = {
    "o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t", "o_orderpriority": "s",
}
LINE = {
    "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n",
    "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t",
}


def _types_sql(table: str, cols: dict[str, str]) -> str:
    parts = []
    for c, kind in cols.items():
        whole = f"bool_and({c} = floor({c}))" if kind == "n" else "false"
        parts.append(f"""SELECT '{c}' AS "column", CASE WHEN '{kind}' = 't' THEN 'datetime' WHEN count(DISTINCT {c}) <= 2 THEN 'binary' WHEN '{kind}' = 's' THEN 'categorical'
        WHEN {whole} AND (count(DISTINCT {c}) <= 10 OR count(DISTINCT {c}) < 0.05 * count({c})) THEN 'discrete' ELSE 'continuous' END AS var_type,
        count(DISTINCT {c}) AS "distinct", count({c}) AS known FROM {table}""")
    return " UNION ALL ".join(parts)


@query("profile_var_types", _types_sql("lineitem", LINE))
def profile_var_types(spark, sf):
    return profile.profile_var_types(load(spark, sf, "lineitem"))


def _k2(n: str, g1: str, g2: str) -> str:
    """D'Agostino-Pearson K² as nested SQL."""
    return f"""(SELECT z1 * z1 + z2 * z2 FROM (SELECT
      (1 / sqrt(0.5 * ln(w2))) * ln(y / sqrt(2.0 / (w2 - 1)) + sqrt(power(y / sqrt(2.0 / (w2 - 1)), 2) + 1)) AS z1,
      (1 - 2 / (9 * big) - sign((1 - 2 / big) / (1 + x * sqrt(2.0 / (big - 4)))) * power(abs((1 - 2 / big) / (1 + x * sqrt(2.0 / (big - 4)))), 1.0 / 3.0)) / sqrt(2 / (9 * big)) AS z2
      FROM (SELECT y, x, -1 + sqrt(2 * (beta2 - 1)) AS w2, 6.0 + 8.0 / b1 * (2.0 / b1 + sqrt(1 + 4.0 / (b1 * b1))) AS big FROM (SELECT
        g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
        (g2 + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1
        FROM (SELECT {n}::DOUBLE AS n, {g1} AS g1, {g2} AS g2)))))"""


def _norm_rows(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, avg(power({c} - m, 3)) / power(var_pop({c}), 1.5) AS skew, kurtosis_pop({c}) AS kurtosis
        FROM (SELECT {c}, avg({c}) OVER () AS m FROM {table}) GROUP BY m"""
        for c in cols
    )


NORM_SQL = f"""WITH s AS ({_norm_rows('events', ['value'])} UNION ALL {_norm_rows('orders', ['o_totalprice'])} UNION ALL {_norm_rows('lineitem', ['l_extendedprice', 'l_discount'])}),
k AS (SELECT *, {_k2('s.n', 's.skew', 's.kurtosis')} AS k2 FROM s)
SELECT "column", n, skew, kurtosis, k2, CASE WHEN exp(-k2 / 2) > 0.05 THEN 'gaussian' WHEN kurtosis > 2 THEN 'heavy_tailed' WHEN abs(skew) > 1 THEN 'skewed_non_gaussian' ELSE 'non_gaussian' END AS distribution FROM k"""


@query("profile_normality", rounded_sql(NORM_SQL, '"column" n distribution', "skew kurtosis k2", 4))
def profile_normality(spark, sf):
    parts = [
        profile.profile_normality(load(spark, sf, t), cols)
        for t, cols in (("events", ["value"]), ("orders", ["o_totalprice"]), ("lineitem", ["l_extendedprice", "l_discount"]))
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(out.select("column", "n", "skew", "kurtosis", "k2", "distribution"), 4)


@query(
    "profile_overall",
    f"""WITH t AS ({_types_sql('orders', TYPES)}), c AS (SELECT count(*) AS n_features, count(*) FILTER (var_type = 'continuous') AS n_continuous,
    count(*) FILTER (var_type = 'discrete') AS n_discrete, count(*) FILTER (var_type = 'binary') AS n_binary, count(*) FILTER (var_type = 'categorical') AS n_categorical,
    count(*) FILTER (var_type = 'datetime') AS n_datetime FROM t),
    nrm AS (SELECT t."column", s.* EXCLUDE ("column"), {_k2('s.n', 's.skew', 's.kurtosis')} AS k2 FROM t JOIN ({_norm_rows('orders', ['o_orderkey', 'o_custkey', 'o_totalprice'])}) s USING ("column") WHERE var_type = 'continuous'),
    d AS (SELECT count(*) AS n_tested, count(*) FILTER (exp(-k2 / 2) > 0.05) AS n_gaussian, count(*) FILTER (exp(-k2 / 2) <= 0.05 AND kurtosis > 2) AS n_heavy,
    count(*) FILTER (exp(-k2 / 2) <= 0.05 AND kurtosis <= 2 AND abs(skew) > 1) AS n_skewed FROM nrm), r AS (SELECT count(*) AS n_rows FROM orders)
    SELECT n_features, n_continuous, n_discrete, n_binary, n_categorical, n_datetime, n_rows, n_tested,
    CASE WHEN n_continuous = n_features THEN 'continuous' WHEN n_continuous >= 0.8 * n_features THEN 'mostly_continuous'
    WHEN n_discrete + n_binary + n_categorical = n_features THEN 'discrete' WHEN n_discrete + n_binary + n_categorical >= 0.8 * n_features THEN 'mostly_discrete' ELSE 'mixed' END AS overall_type,
    CASE WHEN n_tested = 0 THEN 'unknown' WHEN n_gaussian / n_tested > 0.8 THEN 'gaussian' WHEN n_gaussian / n_tested > 0.5 THEN 'mostly_gaussian'
    WHEN n_skewed > n_heavy THEN 'skewed' WHEN n_heavy > 0 THEN 'heavy_tailed' ELSE 'non_gaussian' END AS overall_distribution,
    n_rows >= 30 AS enough_parametric, n_rows >= 100 AS enough_nonparametric, n_rows >= greatest(30, 10 * n_features) AS enough_structure, n_rows >= 200 AS enough_nonlinear,
    n_rows >= 20 * n_features AS enough_high_dimensional, n_rows >= 50 AS enough_series FROM c, d, r""",
)
def profile_overall(spark, sf):
    return profile.profile_overall(load(spark, sf, "orders")).drop("n_unknown", "n_gaussian", "n_skewed", "n_heavy")


QS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _numeric_sql() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        qs = ", ".join(f"quantile_cont({c}, {q}) AS q{int(q * 100)}" for q in QS)
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
        avg(power({c} - m, 3)) / power(var_pop({c}), 1.5) AS skew, kurtosis_pop({c}) AS kurtosis, max({c}) - min({c}) AS range, median({c}) AS median,
        quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, {qs} FROM (SELECT {c}, avg({c}) OVER () AS m FROM lineitem) GROUP BY m""")
    return " UNION ALL ".join(parts)


NUMERIC_OUT = "mean std min max skew kurtosis range median iqr " + " ".join(f"q{int(q * 100)}" for q in QS)


@query("profile_numeric_stats", rounded_sql(_numeric_sql(), '"column" count', NUMERIC_OUT, 4))
def profile_numeric_stats(spark, sf):
    return rounded(profile.profile_numeric_stats(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


def _cat_sql() -> str:
    parts = []
    for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type")):
        parts.append(f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS known, count(*) AS unique_values, first(v ORDER BY n DESC, v) AS most_common,
        100.0::DOUBLE * max(n) / sum(n) AS most_common_percentage, -sum(n / tot * ln(n / tot)) AS entropy,
        list(v ORDER BY n DESC, v)[1:5] AS top_values, list(n ORDER BY n DESC, v)[1:5] AS top_counts
        FROM (SELECT {c} AS v, count(*) AS n, sum(count(*)) OVER ()::DOUBLE AS tot FROM {t} GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@query("profile_categorical_stats", rounded_sql(_cat_sql(), '"column" known unique_values most_common top_values top_counts', "most_common_percentage entropy"))
def profile_categorical_stats(spark, sf):
    return rounded(profile.profile_categorical_stats(load(spark, sf, "part"), ["p_name", "p_brand", "p_type"]))


@query(
    "profile_datetime_stats",
    """SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min_date, max(l_shipdate) AS max_date, date_diff('day', min(l_shipdate), max(l_shipdate)) AS range_days,
    count(DISTINCT l_shipdate) AS unique_dates, year(min(l_shipdate))::INT AS first_year, year(max(l_shipdate))::INT AS last_year,
    (SELECT year(l_shipdate)::INT FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_year,
    (SELECT month(l_shipdate)::INT FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_month FROM lineitem""",
)
def profile_datetime_stats(spark, sf):
    return profile.profile_datetime_stats(load(spark, sf, "lineitem"), ["l_shipdate"])


@query(
    "datetime_counts",
    """SELECT 'year' AS part, year(o_orderdate)::INT AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'month', month(o_orderdate)::INT, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'weekday', (isodow(o_orderdate) - 1)::INT, count(*) FROM orders GROUP BY 2""",
)
def datetime_counts(spark, sf):
    return profile.datetime_counts(load(spark, sf, "orders"), "o_orderdate")


@query(
    "profile_temporal",
    """WITH d AS (SELECT 'o_orderdate' AS c, epoch_us(o_orderdate) AS v FROM orders UNION SELECT 'order_year', year(o_orderdate) FROM orders),
    g AS (SELECT c, v - lag(v) OVER (PARTITION BY c ORDER BY v) AS s FROM d),
    e AS (SELECT c, min(s) = max(s) AND count(*) > 2 AS constant_step FROM g GROUP BY c)
    SELECT c AS "column", c = 'o_orderdate' AS by_type, true AS by_name, constant_step FROM e""",
)
def profile_temporal(spark, sf):
    df = load(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    return profile.profile_temporal(df)


@query(
    "histogram",
    rounded_sql("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT unnest(range(30))::INT AS bin),
    h AS (SELECT least(floor((l_extendedprice - lo) * 30 / (hi - lo))::INT, 29) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
    SELECT 'l_extendedprice' AS "column", bin, lo + (hi - lo) * bin / 30 AS low, lo + (hi - lo) * (bin + 1) / 30 AS high, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin), s""",
                '"column" bin n', "low high", 4),
)
def histogram(spark, sf):
    return rounded(profile.histogram(load(spark, sf, "lineitem"), ["l_extendedprice"], 30), 4)


@query(
    "kde",
    rounded_sql("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*)::DOUBLE AS n, stddev_samp(value) * power(count(*), -0.2) AS h FROM events),
    c AS (SELECT lo + (hi - lo) * (least(floor((value - lo) * 1000 / (hi - lo))::INT, 999) + 0.5) / 1000 AS m, count(*) AS k FROM events, s GROUP BY 1),
    g AS (SELECT lo + i * ((hi - lo) / 199) AS x FROM s, (SELECT unnest(range(200)) AS i))
    SELECT x, sum(k * exp(-0.5 * power((x - m) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS density FROM g, c, s GROUP BY x""", "", "x density"),
)
def kde(spark, sf):
    return rounded(profile.kde(load(spark, sf, "events"), "value", 200, 1000))


@query(
    "histogram_2d",
    """WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
    SELECT least(floor((l_quantity - a) * 49 / (b - a))::INT, 48) AS x_bin, least(floor((l_extendedprice - c) * 49 / (d - c))::INT, 48) AS y_bin, count(*) AS n FROM lineitem, s GROUP BY 1, 2""",
)
def histogram_2d(spark, sf):
    return profile.histogram_2d(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "box_stats",
    rounded_sql("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, count(*) AS n, avg(value) AS mean, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
    min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY 1""",
                "event_type n outliers", "mean q1 median q3 whisker_low whisker_high"),
)
def box_stats(spark, sf):
    return rounded(profile.box_stats(load(spark, sf, "events"), "value", ["event_type"]))


@query("value_counts", "SELECT p_name, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, sf):
    return profile.value_counts(load(spark, sf, "part"), "p_name")


@query("group_mean", rounded_sql("SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity_mean, avg(l_extendedprice) AS l_extendedprice_mean FROM lineitem GROUP BY 1, 2",
                                 "l_returnflag l_linestatus", "l_quantity_mean l_extendedprice_mean", 4))
def group_mean(spark, sf):
    return rounded(profile.group_mean(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"]), 4)


@query(
    "crosstab",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def crosstab(spark, sf):
    return profile.crosstab(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "data_summary_text",
    """WITH r AS (SELECT l_quantity AS qty, l_extendedprice AS price, l_quantity * 2 + l_discount AS mix FROM lineitem)
    SELECT 'Variables:' || chr(10) || format('qty: mean={:.2f}, std={:.2f}, min={:.2f}, max={:.2f}', avg(qty), stddev_samp(qty), min(qty), max(qty)) || chr(10)
    || format('price: mean={:.2f}, std={:.2f}, min={:.2f}, max={:.2f}', avg(price), stddev_samp(price), min(price), max(price)) || chr(10)
    || format('mix: mean={:.2f}, std={:.2f}, min={:.2f}, max={:.2f}', avg(mix), stddev_samp(mix), min(mix), max(mix)) || chr(10)
    || 'Strong correlations:' || chr(10) || CASE WHEN abs(corr(qty, mix)) >= 0.5 THEN format('qty and mix: {:.2f}', corr(qty, mix)) ELSE 'none' END AS summary FROM r""",
)
def data_summary_text(spark, sf):
    df = load(spark, sf, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("mix"))
    return profile.data_summary_text(df, ["qty", "price", "mix"])
