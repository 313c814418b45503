"""Correlation, tests, windows and series."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ...operators import association as assoc
from ...operators import windows
from ..registry import load, query, rounded, rounded_sql
from ..sqlstats import chi2_upper, f_upper, ks_upper, t_two_sided

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# line items with derived columns that depend on each other
RICH = """(SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_quantity AS volume, exp(l_quantity / 5.0) AS boom, nullif(l_discount, 0) AS hdisc, nullif(l_tax, 0) AS htax FROM lineitem)"""
RCOLS = ["qty", "price", "disc", "tax", "net", "volume", "boom"]


def rich(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity AS qty", "l_extendedprice AS price", "l_discount AS disc", "l_tax AS tax",
        "l_extendedprice * (1 - l_discount) AS net", "l_extendedprice * l_quantity AS volume", "exp(l_quantity / 5.0D) AS boom",
        "nullif(l_discount, 0) AS hdisc", "nullif(l_tax, 0) AS htax",
    )


def pairs_sql(cols: list[str], src: str, expr: str, where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {expr.format(a=a, b=b)} FROM {src} {where}" for a, b in itertools.combinations(cols, 2)
    )


def _matrix_sql() -> str:
    cols = ["qty", "price", "hdisc", "htax", "net"]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", " + ", ".join(f"corr({a}, {b}) AS {b}" if a != b else f"1.0::DOUBLE AS {b}" for b in cols) + f" FROM {RICH}" for a in cols
    )


@query("corr_matrix", rounded_sql(_matrix_sql(), '"column"', "qty price hdisc htax net"))
def corr_matrix(spark, sf):
    return rounded(assoc.corr_matrix(rich(spark, sf), ["qty", "price", "hdisc", "htax", "net"]))


def _rank_cte(cols: list[str], src: str, where: str = "true") -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in cols)
    return f"(SELECT {ranks} FROM {src} WHERE {where})"


@query("corr_spearman", rounded_sql(pairs_sql(["qty", "price", "hdisc", "boom"], _rank_cte(["qty", "price", "hdisc", "boom"], RICH, "hdisc IS NOT NULL"), "count(*) AS n, corr({a}, {b}) AS r"), "x y n", "r"))
def corr_spearman(spark, sf):
    return rounded(assoc.corr_spearman(rich(spark, sf), ["qty", "price", "hdisc", "boom"]))


# counting pairs is quadratic in SQL, so the whole-table twin works on the distinct value pairs with their counts
@query(
    "corr_kendall",
    rounded_sql("""WITH c AS (SELECT p_size AS x, p_retailprice % 100 AS y, count(*)::DOUBLE AS w FROM part GROUP BY 1, 2),
    d AS (SELECT sum(a.w * b.w) AS d FROM c a JOIN c b ON a.x < b.x AND a.y > b.y),
    t AS (SELECT (SELECT sum(w) FROM c) AS n, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(w) AS s FROM c GROUP BY x)) AS n1,
      (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(w) AS s FROM c GROUP BY y)) AS n2, (SELECT sum(w * (w - 1) / 2) FROM c) AS n12)
    SELECT n::BIGINT AS n, d::BIGINT AS discordant, (n * (n - 1) / 2 - n1 - n2 + n12 - 2 * d) / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)) AS tau FROM d, t""", "n discordant", "tau"),
)
def corr_kendall(spark, sf):
    df = load(spark, sf, "part").withColumn("cents", F.col("p_retailprice") % 100)
    return rounded(assoc.corr_kendall(df, "p_size", "cents"))


STRONG_SQL = f"""SELECT x, y, r, CASE WHEN abs(r) > 0.8 THEN 'very_strong' WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' ELSE 'weak' END AS strength
FROM ({pairs_sql(RCOLS, RICH, 'corr({a}, {b}) AS r')}) WHERE abs(r) >= 0.5"""


@query("strong_correlations", rounded_sql(STRONG_SQL, "x y strength", "r"))
def strong_correlations(spark, sf):
    return rounded(assoc.strong_correlations(rich(spark, sf), RCOLS))


@query(
    "average_correlations",
    rounded_sql(f"""WITH p AS ({pairs_sql(RCOLS, RICH, 'corr({a}, {b}) AS r')}), e AS (SELECT x AS c, r FROM p UNION ALL SELECT y, r FROM p)
    SELECT c AS "column", sum(abs(r)) / 6 AS avg_abs_r FROM e GROUP BY 1""", '"column"', "avg_abs_r"),
)
def average_correlations(spark, sf):
    return rounded(assoc.average_correlations(rich(spark, sf), RCOLS))


@query(
    "corr_clusters",
    f"""WITH RECURSIVE p AS ({pairs_sql(RCOLS, RICH, 'corr({a}, {b}) AS r')}), e AS (SELECT list(x || '>' || y) FILTER (abs(r) >= 0.7) AS e FROM p), st(i, taken, num, out) AS (SELECT 0, []::VARCHAR[], 0, []::STRUCT(cluster INT, "column" VARCHAR)[]
    UNION ALL SELECT i + 1, list_concat(taken, grp), num + (len(grp) > 0)::INT, CASE WHEN len(grp) > 0 THEN list_concat(out, list_transform(list_concat([seed], grp), lambda c: {{'cluster': num, 'column': c}})) ELSE out END
    FROM (SELECT *, cols[i + 1] AS seed, CASE WHEN list_contains(taken, cols[i + 1]) THEN []::VARCHAR[] ELSE list_filter(cols[i + 2:], lambda c: NOT list_contains(taken, c) AND (list_contains(e, cols[i + 1] || '>' || c) OR list_contains(e, c || '>' || cols[i + 1]))) END AS grp
    FROM st, e, (SELECT {RCOLS} AS cols) WHERE i < {len(RCOLS)}))
    SELECT o.cluster, o."column" FROM (SELECT unnest(out) AS o FROM st WHERE i = {len(RCOLS)})""",
)
def corr_clusters(spark, sf):
    return assoc.corr_clusters(rich(spark, sf), RCOLS)


NL = ["qty", "boom", "bent", "price"]
NL_SRC = "(SELECT l_quantity AS qty, exp(l_quantity) AS boom, exp(l_quantity * 2) AS bent, l_extendedprice AS price FROM lineitem)"


@query(
    "nonlinear_candidates",
    rounded_sql(f"""WITH p AS ({pairs_sql(NL, NL_SRC, 'corr({a}, {b}) AS pearson')}), s AS ({pairs_sql(NL, _rank_cte(NL, NL_SRC), 'corr({a}, {b}) AS spearman')})
    SELECT x, y, pearson, spearman, abs(spearman) - abs(pearson) AS difference FROM p JOIN s USING (x, y) WHERE abs(spearman) - abs(pearson) > 0.3 AND abs(spearman) > 0.5""", "x y", "pearson spearman difference"),
)
def nonlinear_candidates(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_quantity AS qty", "exp(l_quantity) AS boom", "exp(l_quantity * 2) AS bent", "l_extendedprice AS price")
    return rounded(assoc.nonlinear_candidates(df, NL))


CATS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey"]
CAT_SRC = "(SELECT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey, CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE 'n' END AS done, CASE WHEN o_totalprice > 250000 AND o_orderstatus <> 'O' THEN 'y' ELSE 'n' END AS big FROM orders JOIN customer ON o_custkey = c_custkey)"


def categories(spark, sf):
    df = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.select(
        "o_orderstatus", "o_orderpriority", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.when(F.col("o_orderstatus") == "F", "y").otherwise("n").alias("done"),
        F.when((F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") != "O"), "y").otherwise("n").alias("big"),
    )


def _chi_sql(cols: list[str]) -> str:
    """chi2 over all cells (empty ones too), with Yates correction on 2x2 tables."""
    parts = []
    for a, b in itertools.combinations(cols, 2):
        parts.append(f"""SELECT '{a}' AS x, '{b}' AS y, sum(o)::BIGINT AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k,
        sum(CASE WHEN r0 = 2 AND k0 = 2 THEN power(abs(o - ra * rb / t) - least(0.5, abs(o - ra * rb / t)), 2) ELSE power(o - ra * rb / t, 2) END / (ra * rb / t)) AS chi2
        FROM (SELECT ra.a, rb.b, ra.c::DOUBLE AS ra, rb.c::DOUBLE AS rb, coalesce(o.c, 0) AS o, sum(ra.c) OVER (PARTITION BY rb.b)::DOUBLE AS t,
          (SELECT count(DISTINCT {a}) FROM {CAT_SRC}) AS r0, (SELECT count(DISTINCT {b}) FROM {CAT_SRC}) AS k0
          FROM (SELECT {a} AS a, count(*) AS c FROM {CAT_SRC} GROUP BY 1) ra CROSS JOIN (SELECT {b} AS b, count(*) AS c FROM {CAT_SRC} GROUP BY 1) rb
          LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS c FROM {CAT_SRC} GROUP BY 1, 2) o ON o.a = ra.a AND o.b = rb.b)""")
    return " UNION ALL ".join(parts)


CHI_COLS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey", "done", "big"]


@query("chi2_independence", rounded_sql(f"SELECT x, y, n, chi2, (r - 1) * (k - 1) AS dof, {chi2_upper('chi2', '(r - 1) * (k - 1)')} AS p_value FROM ({_chi_sql(CHI_COLS)})", "x y n dof", "chi2 p_value"))
def chi2_independence(spark, sf):
    out = assoc.chi2_independence(categories(spark, sf), list(itertools.combinations(CHI_COLS, 2)))
    return rounded(out.select("x", "y", "n", "dof", "chi2", "p_value"))


@query(
    "cramers_v",
    rounded_sql(f"""WITH c AS ({_chi_sql(CHI_COLS)}), f AS (SELECT x, y, n, greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)::DOUBLE) AS phi, r - power(r - 1, 2) / (n - 1) AS rc, k - power(k - 1, 2) / (n - 1) AS kc FROM c),
    v AS (SELECT x, y, n, sqrt(phi / least(kc - 1, rc - 1)) AS v FROM f)
    SELECT x, y, n, v, CASE WHEN v > 0.8 THEN 'very_strong' WHEN v > 0.6 THEN 'strong' WHEN v > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM v""", "x y n strength", "v"),
)
def cramers_v(spark, sf):
    return rounded(assoc.cramers_v(categories(spark, sf), CHI_COLS))


@query(
    "anova_oneway",
    rounded_sql("""WITH g AS (SELECT event_type, count(*)::DOUBLE AS c, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(c) AS n, count(*) AS k, sum(c * m) / sum(c) AS gm, sum(c * v) AS ssw FROM g),
    b AS (SELECT sum(c * power(m - gm, 2)) AS ssb FROM g, t), r AS (SELECT k AS "groups", n::BIGINT AS n, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta2 FROM t, b)
    SELECT *, """ + f_upper("f", '"groups" - 1', 'n - "groups"') + " AS p_value FROM r", '"groups" n', "f eta2 p_value"),
)
def anova_oneway(spark, sf):
    return rounded(assoc.anova_oneway(load(spark, sf, "events"), "value", "event_type")[0])


@query("anova_groups", rounded_sql("SELECT event_type, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY 1", "event_type count", "mean std"))
def anova_groups(spark, sf):
    return rounded(assoc.anova_oneway(load(spark, sf, "events"), "value", "event_type")[1])


@query(
    "linregress",
    rounded_sql(f"""SELECT *, {t_two_sided('slope / std_err', 'n - 2')} AS p_value FROM (SELECT l_returnflag, count(*) AS n, regr_slope(net, qty) AS slope, regr_intercept(net, qty) AS intercept, regr_r2(net, qty) AS r2,
    sqrt((1 - regr_r2(net, qty)) * var_pop(net) / (var_pop(qty) * (count(*) - 2))) AS std_err, covar_samp(qty, net) AS covariance FROM {RICH} GROUP BY 1)""", "l_returnflag n", "slope intercept r2 std_err covariance p_value", 4),
)
def linregress(spark, sf):
    return rounded(assoc.linregress(rich(spark, sf), "qty", "net", ["l_returnflag"]), 4)


@query(
    "correlation_test",
    rounded_sql(f"SELECT l_returnflag, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, {t_two_sided('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} AS p_value FROM (SELECT l_returnflag, count(*) AS n, corr(hdisc, net) AS r FROM {RICH} WHERE hdisc IS NOT NULL GROUP BY 1)", "l_returnflag n", "r t p_value", 5),
)
def correlation_test(spark, sf):
    return rounded(assoc.correlation_test(rich(spark, sf), "hdisc", "net", True, by=["l_returnflag"]).select("l_returnflag", "n", "r", "t", "p_value"), 5)


@query("point_biserial", rounded_sql(f"SELECT *, {t_two_sided('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} AS p_value FROM (SELECT count(*) AS n, max(l_linestatus) AS high, corr(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END, net) AS r FROM {RICH})", "n high", "r p_value"))
def point_biserial(spark, sf):
    return rounded(assoc.point_biserial(rich(spark, sf), "net", "l_linestatus"))


@query("logistic_auc")
def logistic_auc(spark, sf):
    df = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    return rounded(assoc.logistic_auc(df, "n_chars", "quality"))


@query(
    "welch_t",
    rounded_sql("""WITH s AS (SELECT user_id, event_type = 'purchase' AS f, value FROM events), m AS (SELECT user_id, count(*) FILTER (f)::DOUBLE AS a, count(*) FILTER (NOT f)::DOUBLE AS b, avg(value) FILTER (f) AS m1, avg(value) FILTER (NOT f) AS m0,
      var_samp(value) FILTER (f) AS v1, var_samp(value) FILTER (NOT f) AS v0 FROM s GROUP BY 1),
    r AS (SELECT user_id, f, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS r FROM s),
    u AS (SELECT user_id, sum(r) FILTER (f) AS sr FROM r GROUP BY 1),
    w AS (SELECT user_id, a::BIGINT AS n1, b::BIGINT AS n0, m1 AS mean1, m0 AS mean0, (m1 - m0) / sqrt(v1 / a + v0 / b) AS t,
    power(v1 / a + v0 / b, 2) / (power(v1 / a, 2) / (a - 1) + power(v0 / b, 2) / (b - 1)) AS df, sr - a * (a + 1) / 2 AS u FROM m JOIN u USING (user_id))
    SELECT *, """ + t_two_sided("t", "df") + " AS p_value FROM w", "user_id n1 n0", "mean1 mean0 t df u p_value"),
)
def welch_t(spark, sf):
    df = load(spark, sf, "events").withColumn("f", F.col("event_type") == "purchase")
    return rounded(assoc.welch_t(df, "value", "f", ["user_id"]).select("user_id", "n1", "n0", "mean1", "mean0", "t", "df", "u", "p_value"))


@query(
    "ks_two_sample",
    rounded_sql("""WITH s AS (SELECT l_returnflag AS g, l_linestatus = 'O' AS f, l_extendedprice AS v FROM lineitem), c AS (SELECT g, v, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM s GROUP BY 1, 2),
    r AS (SELECT g, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY g) AS ta, sum(b) OVER (PARTITION BY g) AS tb FROM c WINDOW w AS (PARTITION BY g ORDER BY v))
    SELECT *, """ + ks_upper("d", "n1", "n2") + """ AS p_value FROM (SELECT g AS l_returnflag, max(ta)::BIGINT AS n1, max(tb)::BIGINT AS n2, max(abs(ca::DOUBLE / ta - cb::DOUBLE / tb)) AS d FROM r GROUP BY 1)""", "l_returnflag n1 n2", "d p_value"),
)
def ks_two_sample(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("f", F.col("l_linestatus") == "O")
    return rounded(assoc.ks_two_sample(df, "l_extendedprice", "f", ["l_returnflag"]))


def _rpart() -> str:
    """Partial correlation of net and volume given qty, from pairwise correlations."""
    return f"""SELECT l_returnflag, n, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS r FROM
    (SELECT l_returnflag, count(*) AS n, corr(net, volume) AS a, corr(net, qty) AS b, corr(volume, qty) AS c FROM {RICH} GROUP BY 1)"""


@query("partial_corr", rounded_sql(f"SELECT l_returnflag, n, r, r * sqrt((n - 3) / (1 - r * r)) AS t, n - 3 AS df, {t_two_sided('r * sqrt((n - 3) / (1 - r * r))', 'n - 3')} AS p_value FROM ({_rpart()})", "l_returnflag n df", "r t p_value", 4))
def partial_corr(spark, sf):
    return rounded(assoc.partial_corr(rich(spark, sf), "net", "volume", ["qty"], by=["l_returnflag"]).select("l_returnflag", "n", "r", "t", "df", "p_value"), 4)


@query(
    "vif",
    rounded_sql(f"""WITH f AS (SELECT coalesce(hdisc, avg(hdisc) OVER ()) AS hdisc, price, net FROM {RICH}),
    c AS (SELECT corr(hdisc, price) AS a, corr(hdisc, net) AS b, corr(price, net) AS c FROM f), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c),
    v AS (SELECT 'hdisc' AS "column", (1 - c * c) / det AS vif FROM d UNION ALL SELECT 'price', (1 - b * b) / det FROM d UNION ALL SELECT 'net', (1 - a * a) / det FROM d)
    SELECT "column", vif, CASE WHEN vif > 10 THEN 'extreme' WHEN vif > 5 THEN 'high' ELSE 'ok' END AS level FROM v""", '"column" level', "vif", 3),
)
def vif(spark, sf):
    return rounded(assoc.vif(rich(spark, sf), ["hdisc", "price", "net"]), 3)


def regression_sql(y: str, x: str, z: str, src: str, by: str) -> str:
    """OLS of y on x and one control, from moments."""
    return f"""WITH m AS (SELECT {by}, count(*)::DOUBLE AS n, var_pop({x}) AS sxx, var_pop({z}) AS szz, covar_pop({x}, {z}) AS sxz, covar_pop({x}, {y}) AS sxy, covar_pop({z}, {y}) AS szy, var_pop({y}) AS syy FROM {src} GROUP BY ALL),
    b AS (SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM m),
    s AS (SELECT *, n * (syy - b1 * sxy - b2 * szy) AS rss FROM b)
    SELECT {by}, n::BIGINT AS n, b1 AS coefficient, sqrt(rss / (n - 3) * szz / (n * (sxx * szz - sxz * sxz))) AS std_err, 1 - rss / (n * syy) AS r2, 1 - (rss / (n * syy)) * (n - 1) / (n - 3) AS adj_r2 FROM s"""


@query(
    "regression_test",
    rounded_sql(f"SELECT *, {t_two_sided('coefficient / std_err', 'n - 3')} AS p_value FROM ({regression_sql('volume', 'qty', 'disc', RICH, 'l_returnflag')})", "l_returnflag n", "coefficient std_err r2 adj_r2 p_value", 4),
)
def regression_test(spark, sf):
    out = assoc.regression_test(rich(spark, sf), "qty", "volume", ["disc"], by=["l_returnflag"])
    return rounded(out.select("l_returnflag", "n", "coefficient", "std_err", "r2", "adj_r2", "p_value"), 4)


@query(
    "backdoor_compare",
    rounded_sql(f"""SELECT '' AS adjustment, count(*) AS n, regr_slope(net, qty) AS coefficient, regr_r2(net, qty) AS r2 FROM {RICH}
    UNION ALL SELECT 'disc', n, coefficient, r2 FROM ({regression_sql('net', 'qty', 'disc', RICH, '1 AS one')})
    UNION ALL SELECT 'price', n, coefficient, r2 FROM ({regression_sql('net', 'qty', 'price', RICH, '1 AS one')})""", "adjustment n", "coefficient r2", 4),
)
def backdoor_compare(spark, sf):
    return rounded(assoc.backdoor_compare(rich(spark, sf), "qty", "net", [["disc"], ["price"]]).select("adjustment", "n", "coefficient", "r2"), 4)


# one test per customer: a bounded p value made from its orders
TESTS = "(SELECT o_custkey AS test, exp(-sum(o_totalprice) / 200000.0) AS p FROM orders GROUP BY 1)"


@query(
    "multiple_testing",
    rounded_sql(f"""WITH t AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, test) AS k FROM {TESTS}),
    a AS (SELECT test, p, least(p * n, 1.0) AS bonferroni, least(min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS fdr FROM t)
    SELECT test, bonferroni, fdr, fdr < 0.05 AS significant FROM a""", "test significant", "bonferroni fdr", 9),
)
def multiple_testing(spark, sf):
    tests = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("test")).agg(F.exp(-F.sum("o_totalprice") / 200000.0).alias("p"))
    bon = assoc.multiple_testing(tests, "p", ["test"], "bonferroni").select("test", "p", F.col("p_adjusted").alias("bonferroni"))
    fdr = assoc.multiple_testing(bon, "p", ["test"], "fdr").withColumnRenamed("p_adjusted", "fdr")
    return rounded(fdr.select("test", "bonferroni", "fdr", "significant"), 9)


@query("hsic_test")
def hsic_test(spark, sf):
    df = rich(spark, sf)
    a = assoc.hsic_test(df, "qty", "volume").withColumn("pair", F.lit("qty-volume"))
    return rounded(a.unionByName(assoc.hsic_test(df, "qty", "disc").withColumn("pair", F.lit("qty-disc"))), 6)


@query("cond_hsic_test")
def cond_hsic_test(spark, sf):
    return rounded(assoc.cond_hsic_test(rich(spark, sf), "net", "volume", ["price"]), 6)


@query("sample_rows")
def sample_rows(spark, sf):
    return windows.sample_rows(load(spark, sf, "lineitem"), 10_000)


ORDER = ["ts", "event_id"]


@query(
    "lag_features",
    """SELECT event_id, event_type, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def lag_features(spark, sf):
    out = windows.lag_features(load(spark, sf, "events"), ["value"], [1, 3], ORDER, ["event_type"], block_rows=512)
    return out.select("event_id", "event_type", "value_lag1", "value_lag3")


@query("diff_features", rounded_sql("SELECT event_id, value - lag(value, 1) OVER w AS value_diff1, value - lag(value, 2) OVER w AS value_diff2 FROM events WINDOW w AS (ORDER BY ts, event_id)", "event_id", "value_diff1 value_diff2"))
def diff_features(spark, sf):
    return rounded(windows.diff_features(load(spark, sf, "events"), ["value"], [1, 2], ORDER, block_rows=700).select("event_id", "value_diff1", "value_diff2"))


@query(
    "rolling_features",
    rounded_sql("""SELECT event_id, CASE WHEN count(*) OVER w >= 7 THEN avg(value) OVER w END AS value_roll7_mean, CASE WHEN count(*) OVER w >= 7 THEN stddev_samp(value) OVER w END AS value_roll7_std,
    CASE WHEN count(*) OVER w >= 7 THEN min(value) OVER w END AS value_roll7_min, CASE WHEN count(*) OVER w >= 7 THEN max(value) OVER w END AS value_roll7_max,
    CASE WHEN count(*) OVER w >= 7 THEN quantile_cont(value, 0.5) OVER w END AS value_roll7_median FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
                "event_id", "value_roll7_mean value_roll7_std value_roll7_min value_roll7_max value_roll7_median"),
)
def rolling_features(spark, sf):
    fns = ["mean", "std", "min", "max", "median"]
    out = windows.rolling_features(load(spark, sf, "events"), ["value"], [7], fns, ORDER, ["event_type"], block_rows=512)
    return rounded(out.select("event_id", *[f"value_roll7_{f}" for f in fns]))


@query(
    "time_features",
    """SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts) - 1)::INT AS dayofweek, quarter(ts)::INT AS quarter, dayofyear(ts)::INT AS dayofyear,
    weekofyear(ts)::INT AS week, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second FROM events""",
)
def time_features(spark, sf):
    return windows.time_features(load(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@query("parse_datetime", "SELECT o_orderkey, o_orderdate AS stamp, CAST(NULL AS TIMESTAMP) AS bad FROM orders")
def parse_datetime(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("stamp"), F.concat("o_orderstatus", F.lit("-2020")).alias("bad"))
    return windows.parse_datetime(windows.parse_datetime(df, "stamp", "%d/%m/%Y %H:%M:%S"), "bad", "%Y-%m-%d")


@query(
    "resample",
    rounded_sql("""WITH agg AS (SELECT user_id, ts::DATE AS bucket, avg(value) AS mean, sum(value) AS total, min(value) AS lo, max(value) AS hi, median(value) AS med, arg_min(value, (ts, event_id)) AS fst, arg_max(value, (ts, event_id)) AS lst
      FROM events GROUP BY 1, 2), span AS (SELECT user_id, min(bucket) AS a, max(bucket) AS b FROM agg GROUP BY 1),
    cal AS (SELECT user_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS bucket FROM span)
    SELECT user_id, bucket, mean, coalesce(total, 0) AS total, lo, hi, med, fst, lst FROM cal LEFT JOIN agg USING (user_id, bucket)""", "user_id bucket", "mean total lo hi med fst lst"),
)
def resample(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    out = None
    for method, name in (("mean", "mean"), ("sum", "total"), ("min", "lo"), ("max", "hi"), ("median", "med"), ("first", "fst"), ("last", "lst")):
        one = windows.resample(df, "ts", "D", method, ["value"], ["user_id"], ORDER).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["user_id", "bucket"])
    return rounded(out)


@query(
    "resample_periods",
    rounded_sql("""WITH b AS (SELECT 'W' AS rule, (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE AS bucket, o_totalprice FROM orders
    UNION ALL SELECT 'M', last_day(o_orderdate), o_totalprice FROM orders
    UNION ALL SELECT 'Q', last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE), o_totalprice FROM orders
    UNION ALL SELECT 'Y', make_date(year(o_orderdate), 12, 31), o_totalprice FROM orders),
    days AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders),
    cal AS (SELECT 'W' AS rule, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS bucket FROM days UNION SELECT 'M', last_day(d) FROM days
    UNION SELECT 'Q', last_day((date_trunc('quarter', d) + INTERVAL 2 MONTH)::DATE) FROM days UNION SELECT 'Y', make_date(year(d), 12, 31) FROM days)
    SELECT rule, bucket, coalesce(sum(o_totalprice), 0) AS o_totalprice FROM cal LEFT JOIN b USING (rule, bucket) GROUP BY 1, 2""", "rule bucket", "o_totalprice", 2),
)
def resample_periods(spark, sf):
    df, out = load(spark, sf, "orders"), None
    for rule in "WMQY":
        one = windows.resample(df, "o_orderdate", rule, "sum", ["o_totalprice"]).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 2)


# average price per ship day and flag: series of about 2500 days
DAILY = "(SELECT l_returnflag AS flag, l_shipdate AS day, avg(l_extendedprice) AS price, avg(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)"


def daily(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("day")).agg(
        F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.count(F.lit(1)).cast("double").alias("n")
    )


@query(
    "seasonal_decompose",
    rounded_sql(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY day) - 1 AS pos FROM {DAILY}),
    t AS (SELECT *, CASE WHEN count(*) OVER w = 13 THEN (sum(price) OVER w - (lag(price, 6) OVER o + lead(price, 6) OVER o) / 2) / 12 END AS trend FROM d
      WINDOW w AS (PARTITION BY flag ORDER BY day ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), o AS (PARTITION BY flag ORDER BY day)),
    p AS (SELECT flag, pos % 12 AS ph, avg(price - trend) AS raw FROM t GROUP BY 1, 2), s AS (SELECT flag, ph, raw - avg(raw) OVER (PARTITION BY flag) AS seasonal FROM p)
    SELECT t.flag, day, trend AS price_trend, seasonal AS price_seasonal, price - trend - seasonal AS price_residual FROM t JOIN s ON s.flag = t.flag AND s.ph = t.pos % 12""",
                "flag day", "price_trend price_seasonal price_residual", 4),
)
def seasonal_decompose(spark, sf):
    out = windows.seasonal_decompose(daily(spark, sf), "price", 12, ["day"], ["flag"], block_rows=256)
    return rounded(out.select("flag", "day", "price_trend", "price_seasonal", "price_residual"), 4)


@query("stationarity_adf")
def stationarity_adf(spark, sf):
    return rounded(windows.stationarity_adf(daily(spark, sf), "price", ["day"], ["flag"], max_lag=6))


@query(
    "stationarity_kpss",
    rounded_sql(f"""WITH d AS (SELECT flag, day, price - avg(price) OVER (PARTITION BY flag) AS e FROM {DAILY}),
    s AS (SELECT flag, e, sum(e) OVER w AS s, {', '.join(f'e * lag(e, {k}) OVER w AS g{k}' for k in range(1, 6))} FROM d WINDOW w AS (PARTITION BY flag ORDER BY day))
    SELECT flag, count(*) AS n, 5 AS lags, (sum(s * s) / power(count(*), 2)) / ((sum(e * e) + 2 * ({' + '.join(f'sum(g{k}) * (1 - {k} / 6.0::DOUBLE)' for k in range(1, 6))})) / count(*)) AS statistic FROM s GROUP BY 1""",
                "flag n lags", "statistic"),
)
def stationarity_kpss(spark, sf):
    return rounded(windows.stationarity_kpss(daily(spark, sf), "price", ["day"], ["flag"], lags=5).drop("p_value"))


@query("stationarity_verdict")
def stationarity_verdict(spark, sf):
    return windows.stationarity_verdict(daily(spark, sf), "qty", ["day"])
