"""Effects and counterfactuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import effects, graph
from ..registry import load, query, rounded, rounded_sql
from ..sqlstats import covariances, least_squares, t_two_sided
from .q04_association import RICH, regression_sql, rich
from .q05_graphs import CLOSURE, DAG, flows

PAIRS = "pairs AS (SELECT graph_id, quantile_disc(src, 0.3) AS treatment, max(dst) AS outcome FROM (SELECT DISTINCT graph_id, src, 'x' AS k FROM flows) JOIN (SELECT graph_id, max(dst) AS dst FROM flows GROUP BY 1) USING (graph_id) GROUP BY 1)"
AVOID = """walk AS (SELECT p.graph_id, p.treatment AS seed, n.node AS avoid, p.treatment AS cur FROM pairs p JOIN nodes n USING (graph_id) WHERE n.node <> p.treatment
UNION SELECT w.graph_id, w.seed, w.avoid, f.dst FROM walk w JOIN flows f ON f.graph_id = w.graph_id AND f.src = w.cur WHERE f.dst <> w.avoid),
side AS (SELECT p.graph_id, f.src AS seed, p.treatment AS avoid, f.src AS cur FROM pairs p JOIN flows f ON f.graph_id = p.graph_id AND f.dst = p.treatment
UNION SELECT s.graph_id, s.seed, s.avoid, f.dst FROM side s JOIN flows f ON f.graph_id = s.graph_id AND f.src = s.cur WHERE f.dst <> s.avoid)"""


@query(
    "adjustment_sets",
    f"""WITH RECURSIVE {DAG}, nodes AS (SELECT graph_id, src AS node FROM flows UNION SELECT graph_id, dst FROM flows), {PAIRS}, {CLOSURE}, {AVOID},
    par AS (SELECT p.*, f.src AS node FROM pairs p JOIN flows f ON f.graph_id = p.graph_id AND f.dst = p.treatment WHERE f.src <> p.outcome)
    SELECT graph_id, treatment, outcome, 'backdoor' AS kind, node FROM par
    UNION ALL SELECT p.graph_id, treatment, outcome, 'frontdoor', a.b FROM pairs p JOIN closure a ON a.graph_id = p.graph_id AND a.a = p.treatment JOIN closure b ON b.graph_id = p.graph_id AND b.b = p.outcome AND b.a = a.b
      WHERE a.b NOT IN (treatment, outcome) AND NOT EXISTS (FROM walk w WHERE w.graph_id = p.graph_id AND w.seed = p.treatment AND w.avoid = a.b AND w.cur = p.outcome)
    UNION ALL SELECT graph_id, treatment, outcome, 'instrument', node FROM par p WHERE NOT EXISTS (FROM side s WHERE s.graph_id = p.graph_id AND s.seed = p.node AND s.avoid = p.treatment AND s.cur = p.outcome)
      AND NOT EXISTS (FROM closure x JOIN closure y ON x.graph_id = y.graph_id AND x.a = y.a WHERE x.graph_id = p.graph_id AND x.b = p.node AND y.b = p.outcome)""",
)
def adjustment_sets(spark, sf):
    e = flows(spark, sf)
    last = e.groupBy("graph_id").agg(F.max("dst").alias("outcome"))
    srcs = e.select("graph_id", "src").distinct().groupBy("graph_id").agg(F.array_sort(F.collect_list("src")).alias("s"))  # 25 nations
    pick = srcs.select("graph_id", F.element_at("s", F.ceil(F.size("s") * F.lit(0.3)).cast("int")).alias("treatment"))
    return effects.adjustment_sets(e, pick.join(last, "graph_id"))


PER_SUPP = "(SELECT l_suppkey, l_returnflag, l_linestatus, l_quantity AS qty, l_extendedprice * (1 - l_discount) AS net, l_discount AS disc, l_tax AS tax, l_extendedprice AS price FROM lineitem)"


def per_supplier(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity AS qty", "l_extendedprice * (1 - l_discount) AS net", "l_discount AS disc", "l_tax AS tax", "l_extendedprice AS price"
    )


ATE_SQL = f"""SELECT l_suppkey, n1, n0, m1 - m0 AS effect, sqrt(v1 / n1 + v0 / n0) AS std_err FROM (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'O') AS n1, count(*) FILTER (l_linestatus = 'F') AS n0,
avg(net) FILTER (l_linestatus = 'O') AS m1, avg(net) FILTER (l_linestatus = 'F') AS m0, var_samp(net) FILTER (l_linestatus = 'O') AS v1, var_samp(net) FILTER (l_linestatus = 'F') AS v0 FROM {PER_SUPP} GROUP BY 1)"""


@query("ate_difference", rounded_sql(f"SELECT *, effect / std_err AS t, effect - 1.96 * std_err AS ci_low, effect + 1.96 * std_err AS ci_high FROM ({ATE_SQL})", "l_suppkey n1 n0", "effect std_err t ci_low ci_high", 4))
def ate_difference(spark, sf):
    return rounded(effects.ate_difference(per_supplier(spark, sf), "l_linestatus", "net", ["l_suppkey"]).drop("p_value"), 4)


@query("ate_backdoor", rounded_sql(f"SELECT l_suppkey, n, coefficient AS effect, std_err, r2, adj_r2 FROM ({regression_sql('net', 'qty', 'disc', PER_SUPP, 'l_suppkey')})", "l_suppkey n", "effect std_err r2 adj_r2", 4))
def ate_backdoor(spark, sf):
    return rounded(effects.ate_backdoor(per_supplier(spark, sf), "qty", "net", ["disc"], ["l_suppkey"]).select("l_suppkey", "n", "effect", "std_err", "r2", "adj_r2"), 4)


@query("ate_backdoor_dummies")
def ate_backdoor_dummies(spark, sf):
    return rounded(effects.ate_backdoor(per_supplier(spark, sf), "qty", "net", ["disc", "l_returnflag", "l_linestatus"]), 4)


@query(
    "ate_frontdoor",
    rounded_sql(f"""WITH m AS (SELECT l_suppkey, count(*)::DOUBLE AS n, var_pop(qty) AS tt, var_pop(disc) AS mm, var_pop(net) AS yy, covar_pop(qty, disc) AS tm, covar_pop(qty, net) AS ty, covar_pop(disc, net) AS my FROM {PER_SUPP} GROUP BY 1),
    a AS (SELECT *, tm / tt AS a, sqrt((mm - tm * tm / tt) / tt / (n - 2)) AS sa, (my * tt - ty * tm) / (tt * mm - tm * tm) AS b, (ty * mm - my * tm) / (tt * mm - tm * tm) AS c FROM m),
    s AS (SELECT *, sqrt((yy - b * my - c * ty) / (n - 3) * tt / (tt * mm - tm * tm)) AS sb FROM a)
    SELECT l_suppkey, n::BIGINT AS n, a, b, a * b AS effect, sqrt(sa * sa * b * b + sb * sb * a * a) AS std_err FROM s""", "l_suppkey n", "a b effect std_err", 4),
)
def ate_frontdoor(spark, sf):
    return rounded(effects.ate_frontdoor(per_supplier(spark, sf), "qty", "disc", "net", ["l_suppkey"]).select("l_suppkey", "n", "a", "b", "effect", "std_err"), 4)


@query(
    "ate_iv",
    rounded_sql(f"""WITH m AS (SELECT l_suppkey, count(*)::DOUBLE AS n, var_pop(price) AS zz, var_pop(net) AS tt, var_pop(v) AS yy, covar_pop(price, net) AS zt, covar_pop(price, v) AS zy FROM (SELECT *, net * qty AS v FROM {PER_SUPP}) GROUP BY 1)
    SELECT l_suppkey, n::BIGINT AS n, zy / zt AS effect, sqrt((yy - zy * zy / zz) / (n - 2) / (zt * zt / zz)) AS std_err, zt * zt / (zz * tt) / ((1 - zt * zt / (zz * tt)) / (n - 2)) > 10 AS strong FROM m""", "l_suppkey n strong", "effect std_err", 4),
)
def ate_iv(spark, sf):
    df = per_supplier(spark, sf).withColumn("v", F.col("net") * F.col("qty"))
    return rounded(effects.ate_iv(df, "net", "price", "v", ["l_suppkey"]).select("l_suppkey", "n", "effect", "std_err", "strong"), 4)


@query("ate_bootstrap")
def ate_bootstrap(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return rounded(effects.ate_bootstrap(df, "l_quantity", "net", ["l_discount"], key=["l_orderkey", "l_linenumber"]), 4)


def _cate_sql() -> str:
    src = f"(SELECT *, qty * disc AS x_disc, qty * tax AS x_tax FROM {PER_SUPP})"
    xs = ["qty", "disc", "tax", "x_disc", "x_tax", "price"]
    fit = f"""WITH RECURSIVE cov AS ({covariances(src, 'l_suppkey', ['net', *xs])}), {least_squares([('f', 'net', xs)])},
    r AS (SELECT f.g AS l_suppkey, CASE x WHEN 'qty' THEN 'main' WHEN 'x_disc' THEN 'disc' ELSE 'tax' END AS term, coef AS effect, sqrt(rss / (f.n - 7) * inv / f.n) AS std_err, f.n - 7 AS df, 1 - rss / (f.n * syy) AS r2
      FROM fit f JOIN rss USING (g, fam) WHERE x IN ('qty', 'x_disc', 'x_tax'))
    SELECT l_suppkey, term, effect, std_err, effect / std_err AS t, {t_two_sided('effect / std_err', 'df')} AS p_value, r2 FROM r"""
    return rounded_sql(fit, "l_suppkey term", "effect std_err t p_value r2", 4)


@query("cate_interactions", _cate_sql())
def cate_interactions(spark, sf):
    return rounded(effects.cate_interactions(per_supplier(spark, sf), "qty", "net", ["disc", "tax"], ["price"], ["l_suppkey"]), 4)


@query(
    "sensitivity_grid",
    rounded_sql(f"""WITH e AS ({ATE_SQL}), s AS (SELECT unnest([0.0::DOUBLE, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]) AS r)
    SELECT l_suppkey, a.r AS r2_treatment, b.r AS r2_outcome, effect, effect * (1 - sqrt(a.r * b.r)) AS adjusted_effect, effect * (1 - sqrt(a.r * b.r)) - effect AS bias, effect * effect * (1 - sqrt(a.r * b.r)) <= 0 AS flips
    FROM e, s a, s b WHERE NOT (a.r = 0 AND b.r = 0)""", "l_suppkey r2_treatment r2_outcome flips", "effect adjusted_effect bias", 4),
)
def sensitivity_grid(spark, sf):
    eff = effects.ate_difference(per_supplier(spark, sf), "l_linestatus", "net", ["l_suppkey"])
    return rounded(effects.sensitivity_grid(eff, ["l_suppkey"]), 4)


@query(
    "path_effects",
    rounded_sql(f"""WITH r AS (SELECT l_suppkey, regr_slope(net, qty) AS total_effect FROM {PER_SUPP} GROUP BY 1), d AS (SELECT l_suppkey, coefficient AS direct_effect FROM ({regression_sql('net', 'qty', 'disc', PER_SUPP, 'l_suppkey')}))
    SELECT l_suppkey, path, total_effect, direct_effect, total_effect - direct_effect AS indirect_effect, CASE WHEN path = 'qty>net' THEN direct_effect ELSE total_effect - direct_effect END AS path_effect
    FROM r JOIN d USING (l_suppkey), (SELECT unnest(['qty>net', 'qty>disc>net']) AS path)""", "l_suppkey path", "total_effect direct_effect indirect_effect path_effect", 4),
)
def path_effects(spark, sf):
    return rounded(effects.path_effects(per_supplier(spark, sf), "qty", "net", [["qty", "net"], ["qty", "disc", "net"]], ["l_suppkey"]), 4)


STRUCTURE = [("qty", "volume"), ("price", "volume"), ("price", "net"), ("disc", "net"), ("volume", "boom"), ("net", "boom")]


@query(
    "counterfactual",
    rounded_sql(f"""WITH v AS (SELECT regr_slope(volume, qty) AS b, regr_intercept(volume, qty) AS a FROM {RICH}), o AS (SELECT count(*) AS n, avg(volume) AS original_mean FROM {RICH})
    SELECT n, original_mean, a + b * 40 AS mean, a + b * 40 - original_mean AS effect, (a + b * 40 - original_mean) / abs(original_mean) * 100 AS percent,
    CASE WHEN abs((a + b * 40 - original_mean) / original_mean) < 0.05 THEN 'minimal' WHEN abs((a + b * 40 - original_mean) / original_mean) < 0.2 THEN 'moderate' ELSE 'substantial' END AS size FROM v, o""", "n size", "original_mean mean effect percent", 3),
)
def counterfactual(spark, sf):
    out = effects.counterfactual(rich(spark, sf).select("qty", "volume"), [("qty", "volume")], "qty", 40.0, "volume")
    return rounded(out.select("n", "original_mean", "mean", "effect", "percent", "size"), 3)


@query("intervention_compare")
def intervention_compare(spark, sf):
    return rounded(effects.intervention_compare(rich(spark, sf), STRUCTURE, "qty", [5.0, 25.0, 45.0], "boom"), 4)
