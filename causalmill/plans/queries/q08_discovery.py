"""Structure learning."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ...functions.lineage import cut_lineage
from ...functions.moments import moment_rows
from ...operators.discovery import constraint, ensemble, lingam, pairwise, score, shift, temporal
from ..registry import load, query, rounded, rounded_sql
from ..sqlstats import chi2_upper, covariances, f_upper, least_squares
from .q04_association import RICH, rich
from .q05_graphs import CYC, DAG, flows

MCOLS = ["qty", "price", "disc", "net"]


def _gram_sql() -> str:
    means = ", ".join(f"avg({c})" for c in MCOLS)
    covs = ", ".join(f"covar_pop({a}, {b})" for a in MCOLS for b in MCOLS)
    return f"""SELECT l_returnflag, count(*) AS n, list_transform([{means}], lambda v: round(v, 4) + 0.0) AS means, list_transform([{covs}], lambda v: round(v, 2) + 0.0) AS cov FROM {RICH} GROUP BY 1"""


@query("gram_stats", _gram_sql())
def gram_stats(spark, sf):
    m = moment_rows(rich(spark, sf), MCOLS, ["l_returnflag"])
    return m.select("l_returnflag", "n", F.transform("means", lambda v: F.round(v, 4) + 0.0).alias("means"), F.transform("cov", lambda v: F.round(v, 2) + 0.0).alias("cov"))


PCOLS = ["disc", "net", "price", "qty", "tax", "volume"]


def _noisy(spark, sf):
    """Line items with derived columns plus noise taken from a hash of the row, so that no column is an exact function."""
    df = load(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS flag", "l_quantity AS qty", "l_extendedprice / 1000 AS price", "l_discount * 100 AS disc", "l_tax * 100 AS tax",
        "pmod(xxhash64(l_orderkey, l_partkey, l_linenumber, 1), 1000) / 1000.0D AS u1", "pmod(xxhash64(l_orderkey, l_partkey, l_linenumber, 2), 1000) / 1000.0D AS u2",
    )
    df = df.withColumn("net", F.col("price") - 2 * F.col("disc") + 20 * F.col("u1")).withColumn("volume", F.col("qty") + 0.5 * F.col("net") + 20 * F.col("u2"))
    return df.select("flag", *PCOLS)


@query("ci_test_batch")
def ci_test_batch(spark, sf):
    df = _noisy(spark, sf)
    pairs = constraint.all_pairs(df, PCOLS, "flag")
    none = pairs.withColumn("given", F.array().cast("array<string>"))
    one = pairs.withColumn("given", F.array(F.lit("tax"))).where("x != 'tax' AND y != 'tax'")
    return rounded(constraint.ci_test_batch(constraint.fisher_z(df, PCOLS, "flag"), none.unionByName(one)))


def _levels(spark, sf):
    """Categories of orders and customers."""
    df = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return df.select(
        F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") > 250000).alias("big"), F.when(F.col("o_totalprice") > 400000, "top").when(F.col("o_totalprice") > 250000, F.col("o_orderstatus")).otherwise("low").alias("band"),
    )


@query("ci_test_counts")
def ci_test_counts(spark, sf):
    df = _levels(spark, sf)
    cols = ["segment", "status", "priority", "big", "band"]
    tests = constraint.all_pairs(df, cols).withColumn("given", F.array(F.lit("segment"))).where("x != 'segment' AND y != 'segment'")
    return rounded(constraint.ci_test_batch(constraint.count_test(df, cols, None, "g2"), tests))


@query("pc_skeleton")
def pc_skeleton(spark, sf):
    df = _noisy(spark, sf)
    return constraint.pc_skeleton(constraint.fisher_z(df, PCOLS, "flag"), constraint.all_pairs(df, PCOLS, "flag"), 0.001)[0]


@query("orient_cpdag")
def orient_cpdag(spark, sf):
    return constraint.pc(_noisy(spark, sf), PCOLS, "fisherz", 0.001, "flag")


@query("pc_counts")
def pc_counts(spark, sf):
    return constraint.pc(_levels(spark, sf), ["segment", "status", "priority", "big", "band"], "g2", 0.01)


@query("pc_kernel")
def pc_kernel(spark, sf):
    return constraint.pc(_noisy(spark, sf), ["disc", "net", "price", "tax"], "kernel", 0.01, max_given=2)


@query("pag_orient")
def pag_orient(spark, sf):
    return constraint.fci(_noisy(spark, sf), PCOLS, "fisherz", 0.001, "flag")


@query("context_pc")
def context_pc(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("year(l_shipdate) AS year", "l_quantity + (year(l_shipdate) - 1998) * 3 AS qty", "l_extendedprice / 1000 AS price", "l_quantity * 2 + l_discount * 100 AS mix")
    return constraint.context_pc(df, ["qty", "price", "mix"], "year", 0.001)


FAMS = [("net", []), ("net", ["price"]), ("net", ["disc", "price"]), ("volume", ["net", "qty"]), ("qty", [])]


def _families(df):
    rows = F.array(*[F.struct(F.lit(n).alias("node"), F.array(*[F.lit(p) for p in ps]).cast("array<string>").alias("parents")) for n, ps in FAMS])
    return constraint.with_graph(df, "flag").select("graph_id").distinct().select("graph_id", F.inline(rows))


@query("score_batch")
def score_batch(spark, sf):
    df = cut_lineage(_noisy(spark, sf))
    bic = score.score_batch(score.bic_scorer(df, PCOLS, "flag"), _families(df)).withColumn("kind", F.lit("bic"))
    cv = score.score_batch(score.cv_scorer(df, PCOLS, PCOLS, 5, "flag"), _families(df)).withColumn("kind", F.lit("cv"))
    return rounded(bic.unionByName(cv), 3)


@query("score_bdeu")
def score_bdeu(spark, sf):
    df = _levels(spark, sf)
    cols = ["segment", "status", "priority", "big", "band"]
    fams = [("band", []), ("band", ["big"]), ("band", ["big", "status"]), ("status", ["segment"])]
    rows = F.array(*[F.struct(F.lit(n).alias("node"), F.array(*[F.lit(p) for p in ps]).cast("array<string>").alias("parents")) for n, ps in fams])
    families = spark.createDataFrame([("all",)], "graph_id string").select("graph_id", F.inline(rows))
    return rounded(score.score_batch(score.bdeu_scorer(df, cols), families), 3)


@query("greedy_search")
def greedy_search(spark, sf):
    df = _noisy(spark, sf)
    return score.greedy_search(score.bic_scorer(df, PCOLS, "flag"), constraint.with_graph(df, "flag"), PCOLS)


@query("direct_lingam")
def direct_lingam(spark, sf):
    return rounded(lingam.direct_lingam(_noisy(spark, sf), ["disc", "price", "net", "qty", "volume"]), 3)


# daily averages per flag: the series of the temporal operators
SERIES = ["price", "qty", "disc", "tax"]
DAYS = "(SELECT l_returnflag AS graph_id, l_shipdate AS day, avg(l_extendedprice) / 1000 AS price, avg(l_quantity) AS qty, avg(l_discount) * 100 AS disc, avg(l_tax) * 100 AS tax FROM lineitem GROUP BY 1, 2)"


def days(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("day")).agg(
        (F.avg("l_extendedprice") / 1000).alias("price"), F.avg("l_quantity").alias("qty"), (F.avg("l_discount") * 100).alias("disc"), (F.avg("l_tax") * 100).alias("tax")
    )


def _lagged(lags: int) -> str:
    cols = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for k in range(1, lags + 1) for c in SERIES)
    return f"(SELECT *, {cols} FROM {DAYS} WINDOW w AS (PARTITION BY graph_id ORDER BY day))"


def _known(lags: int) -> str:
    return " AND ".join(f"{c}_{lags} IS NOT NULL" for c in SERIES)


def _var_sql(lags: int, threshold: float) -> str:
    xs = [f"{c}_{k}" for k in range(1, lags + 1) for c in SERIES]
    parts = "str_split(x, '_')"
    return f"""WITH RECURSIVE cov AS ({covariances(_lagged(lags), 'graph_id', [*SERIES, *xs], _known(lags))}), {least_squares([(c, c, xs) for c in SERIES])},
    c AS (SELECT g AS graph_id, {parts}[1] AS src, fam AS dst, {parts}[2]::INT AS lag, abs(coef) AS a FROM fit WHERE {parts}[1] <> fam)
    SELECT graph_id, src, dst, min(lag) FILTER (a > {threshold}) AS time_lag, sum(a) AS weight FROM c GROUP BY ALL HAVING count(*) FILTER (a > {threshold}) > 0"""


@query("var_fit", rounded_sql(_var_sql(3, 0.02), "graph_id src dst time_lag", "weight"))
def var_fit(spark, sf):
    return rounded(temporal.var_fit(days(spark, sf), SERIES, ["day"], 3, 0.02, "flag"))


def _granger_sql() -> str:
    parts = []
    for x, y in itertools.permutations(SERIES, 2):
        parts.append(f"""SELECT graph_id, '{x}' AS src, '{y}' AS dst, 1 AS lag, ((rr - ru) / 1) / (ru / (n - 3)) AS f FROM (
        SELECT graph_id, n, n * (syy - sy1 * sy1 / s11) AS rr, n * (syy - (sy1 * (sy1 * s22 - sy2 * s12) + sy2 * (sy2 * s11 - sy1 * s12)) / (s11 * s22 - s12 * s12)) AS ru FROM (
        SELECT graph_id, count(*)::DOUBLE AS n, var_pop({y}) AS syy, var_pop({y}_1) AS s11, var_pop({x}_1) AS s22, covar_pop({y}_1, {x}_1) AS s12, covar_pop({y}, {y}_1) AS sy1, covar_pop({y}, {x}_1) AS sy2 FROM lagged WHERE {y}_1 IS NOT NULL GROUP BY 1))""")
    lags = ", ".join(f"lag({c}) OVER w AS {c}_1" for c in SERIES)
    return f"WITH lagged AS (SELECT *, {lags} FROM {DAYS} WINDOW w AS (PARTITION BY graph_id ORDER BY day)) " + " UNION ALL ".join(parts)


@query("granger_tests", rounded_sql(_granger_sql(), "graph_id src dst lag", "f", 5))
def granger_tests(spark, sf):
    lagged = temporal.lagged_table(days(spark, sf), SERIES, 1, ["day"], "flag")
    return rounded(temporal.granger_tests(lagged, SERIES, 1).drop("p_value"), 5)


def _granger_pairs_sql(lags: int, alpha: float) -> str:
    """Per lag length the rows that know all its lags; restricted and full families of every ordered pair."""
    parts = []
    for size in range(1, lags + 1):
        names = [f"{c}_{k}" for k in range(1, size + 1) for c in SERIES]
        own = {c: [f"{c}_{k}" for k in range(1, size + 1)] for c in SERIES}
        families = [(y, y, own[y]) for y in SERIES] + [(f"{x}>{y}", y, own[y] + own[x]) for x, y in itertools.permutations(SERIES, 2)]
        parts.append(f"""(WITH RECURSIVE cov AS ({covariances(_lagged(size), 'graph_id', [*SERIES, *names], _known(size))}), {least_squares(families)},
        f AS (SELECT b.g AS graph_id, str_split(b.fam, '>')[1] AS src, str_split(b.fam, '>')[2] AS dst, {size} AS lag, ((a.rss - b.rss) / {size}) / (b.rss / (b.n - {2 * size + 1})) AS f, b.n - {2 * size + 1} AS d2
          FROM rss b JOIN rss a ON a.g = b.g AND a.fam = str_split(b.fam, '>')[2] WHERE contains(b.fam, '>'))
        SELECT graph_id, src, dst, lag, {f_upper('f', str(size), 'd2')} AS p FROM f)""")
    return f"""SELECT graph_id, src, dst, arg_min(lag, p) AS time_lag, min(p) AS p_value, 1 - min(p) AS weight FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL HAVING min(p) < {alpha}"""


@query("granger_pairwise", rounded_sql(_granger_pairs_sql(3, 0.2), "graph_id src dst time_lag", "p_value weight"))
def granger_pairwise(spark, sf):
    return rounded(temporal.granger_pairwise(days(spark, sf), SERIES, ["day"], 3, 0.2, "flag"))


@query("granger_lasso")
def granger_lasso(spark, sf):
    return rounded(temporal.granger_lasso(days(spark, sf), SERIES, ["day"], 2, 0.02, "flag"))


def _instant_sql(threshold: float) -> str:
    """``mix`` is a sum of two others, so its lag adds nothing to the regression."""
    names = ["price", "qty", "disc", "mix"]
    lags = ", ".join(f"lag({c}) OVER w AS {c}_1" for c in names)
    src = f"(SELECT *, {lags} FROM (SELECT *, qty + disc AS mix FROM {DAYS}) WINDOW w AS (PARTITION BY graph_id ORDER BY day))"
    xs = ["price_1", "qty_1", "disc_1"]
    return f"""WITH RECURSIVE cov AS ({covariances(src, 'graph_id', [*names, *xs], 'price_1 IS NOT NULL AND qty_1 IS NOT NULL AND disc_1 IS NOT NULL')}), {least_squares([(c, c, xs) for c in names])},
    res AS (SELECT s.g, s.a, s.b, any_value(s.v) - sum(f.coef * c.v) AS v FROM cov s JOIN fit f ON f.g = s.g AND f.fam = s.a JOIN cov c ON c.g = s.g AND c.a = f.x AND c.b = s.b
      WHERE s.a IN {tuple(names)} AND s.b IN {tuple(names)} GROUP BY 1, 2, 3),
    r AS (SELECT x.g AS graph_id, x.a AS src, x.b AS dst, abs(x.v) / sqrt(p.v * q.v) AS weight FROM res x JOIN res p ON p.g = x.g AND p.a = x.a AND p.b = x.a JOIN res q ON q.g = x.g AND q.a = x.b AND q.b = x.b WHERE x.a <> x.b)
    SELECT graph_id, src, dst, weight, true AS instantaneous FROM r WHERE weight > {threshold}"""


@query("instantaneous_effects", rounded_sql(_instant_sql(0.3), "graph_id src dst instantaneous", "weight"))
def instantaneous_effects(spark, sf):
    df = days(spark, sf).withColumn("mix", F.col("qty") + F.col("disc"))
    return rounded(temporal.instantaneous_effects(df, ["price", "qty", "disc", "mix"], ["day"], 1, 0.3, "flag"))


@query("var_lingam")
def var_lingam(spark, sf):
    df = load(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg((F.avg("l_extendedprice") / 1000).alias("price"), F.avg("l_quantity").alias("qty"), (F.avg("l_discount") * 100).alias("disc"))
    return rounded(temporal.var_lingam(df.withColumn("mix", F.col("qty") + F.col("disc") + F.col("price")), ["price", "qty", "mix"], ["day"], 1), 3)


TE_BINS = 10


def _te_sql() -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for c in SERIES for k in (1, 2))
    out = []
    for k in (1, 2):
        def code(x):
            return f"least(floor(({x} - min({x}) OVER g) * {TE_BINS} / (max({x}) OVER g - min({x}) OVER g)), {TE_BINS - 1})::INT"

        codes = ", ".join(f"{code(c)} AS n_{c}, {code(f'{c}_{k}')} AS l_{c}" for c in SERIES)
        binned = f"(SELECT graph_id, {codes} FROM lagged WHERE {SERIES[0]}_{k} IS NOT NULL WINDOW g AS (PARTITION BY graph_id))"
        for s, t in itertools.permutations(SERIES, 2):
            out.append(f"SELECT graph_id, '{s}' AS src, '{t}' AS dst, {k} AS lag, l_{s} AS a, n_{t} AS b, l_{t} AS c FROM {binned}")
    cells = f"cells AS (SELECT graph_id, src, dst, lag, a, b, c, count(*)::DOUBLE AS n FROM ({' UNION ALL '.join(out)}) GROUP BY ALL)"
    h = lambda g: f"(SELECT graph_id, src, dst, lag, sum(n * log2(n)) AS h, sum(n) AS t FROM (SELECT graph_id, src, dst, lag, sum(n) AS n FROM cells GROUP BY graph_id, src, dst, lag, {g}) GROUP BY ALL)"
    return f"""WITH lagged AS (SELECT *, {lags} FROM {DAYS} WINDOW w AS (PARTITION BY graph_id ORDER BY day)), {cells}
    SELECT graph_id, src, dst, lag, greatest((c.h - bc.h - ac.h + abc.h) / c.t, 0) AS te FROM {h('c')} c JOIN {h('b, c')} bc USING (graph_id, src, dst, lag) JOIN {h('a, c')} ac USING (graph_id, src, dst, lag) JOIN {h('a, b, c')} abc USING (graph_id, src, dst, lag)"""


@query("transfer_entropy", rounded_sql(_te_sql(), "graph_id src dst lag", "te"))
def transfer_entropy(spark, sf):
    return rounded(temporal.transfer_entropy(days(spark, sf), SERIES, ["day"], 2, TE_BINS, by="flag", all_lags=True))


@query("transfer_entropy_graph")
def transfer_entropy_graph(spark, sf):
    return rounded(temporal.transfer_entropy(days(spark, sf), SERIES, ["day"], 2, TE_BINS, by="flag"))


# two edge tables from the trade graph: edges with and without delay
@query(
    "combine_temporal",
    rounded_sql(f"""WITH {DAG}, t AS (SELECT graph_id, src, dst, time_lag, weight FROM flows WHERE time_lag >= 1), i AS (SELECT graph_id, src, dst, coalesce(confidence, 0.1) AS w FROM flows WHERE bidirected)
    SELECT coalesce(t.graph_id, i.graph_id) AS graph_id, coalesce(t.src, i.src) AS src, coalesce(t.dst, i.dst) AS dst, time_lag, greatest(weight, w) AS weight, w IS NOT NULL AS instantaneous
    FROM t FULL JOIN i ON t.graph_id = i.graph_id AND t.src = i.src AND t.dst = i.dst""", "graph_id src dst time_lag instantaneous", "weight"),
)
def combine_temporal(spark, sf):
    e = flows(spark, sf)
    now = e.where("bidirected").select("graph_id", "src", "dst", F.coalesce("confidence", F.lit(0.1)).alias("weight"))
    return rounded(temporal.combine_temporal(e.where("time_lag >= 1"), now))


SHIFT = """(SELECT year(l_shipdate)::INT AS period, l_quantity + greatest(year(l_shipdate) - 1999, 0) * 5 AS qty, l_extendedprice AS price, l_discount AS disc, l_discount * 100 + l_quantity * greatest(year(l_shipdate) - 1998, 0) / 3.0::DOUBLE AS mix FROM lineitem)"""
SCOLS = ["disc", "mix", "price", "qty"]


def shifted(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(
        "year(l_shipdate) AS period", "l_quantity + greatest(year(l_shipdate) - 1999, 0) * 5 AS qty", "l_extendedprice AS price", "l_discount AS disc",
        "l_discount * 100 + l_quantity * greatest(year(l_shipdate) - 1998, 0) / 3.0D AS mix",
    )


def _ks_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", period, {c} AS v FROM {SHIFT}" for c in SCOLS)
    return f"""WITH l AS ({long}), c AS (SELECT "column", period, v, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT DISTINCT a."column", a.period AS p1, b.period AS p2 FROM (SELECT DISTINCT "column", period FROM c) a JOIN (SELECT DISTINCT "column", period FROM c) b ON a."column" = b."column" AND a.period < b.period),
    m AS (SELECT p."column", p1, p2, v, sum(CASE WHEN period = p1 THEN n ELSE 0 END) AS a, sum(CASE WHEN period = p2 THEN n ELSE 0 END) AS b FROM p JOIN c ON c."column" = p."column" AND period IN (p1, p2) GROUP BY ALL),
    r AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER q AS ta, sum(b) OVER q AS tb FROM m WINDOW w AS (PARTITION BY "column", p1, p2 ORDER BY v), q AS (PARTITION BY "column", p1, p2)),
    d AS (SELECT "column", p1, p2, max(abs(ca::DOUBLE / ta - cb::DOUBLE / tb)) AS d FROM r GROUP BY ALL)
    SELECT "column", count(*) AS pairs, max(d) AS max_d FROM d GROUP BY 1"""


@query("distribution_change", rounded_sql(_ks_sql(), '"column" pairs', "max_d"))
def distribution_change(spark, sf):
    return rounded(shift.distribution_change(shifted(spark, sf), SCOLS, "period").select("column", "pairs", "max_d"))


def _rel_sql() -> str:
    per = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, period, count(*) AS n, corr({a}, {b}) AS r FROM {SHIFT} GROUP BY period" for a, b in itertools.combinations(SCOLS, 2))
    return f"""WITH p AS ({per}), k AS (SELECT *, atanh(greatest(least(r, 1 - 1e-12), -1 + 1e-12)) AS z, (n - 3)::DOUBLE AS w FROM p WHERE n >= 10 AND NOT isnan(r))
    SELECT x, y, count(*) AS periods, sum(w * z * z) - sum(w * z) * sum(w * z) / sum(w) AS statistic, var_pop(r) AS strength FROM k GROUP BY 1, 2"""


@query(
    "relation_change",
    rounded_sql(f"WITH p AS (SELECT *, {chi2_upper('statistic', '(periods - 1)')} AS p_value FROM ({_rel_sql()})) SELECT *, p_value < 0.05 AS changing FROM p", "x y periods changing", "statistic strength p_value", 4),
)
def relation_change(spark, sf):
    return rounded(shift.relation_change(shifted(spark, sf), SCOLS, "period").select("x", "y", "periods", "statistic", "strength", "p_value", "changing"), 4)


def _nonstationary_sql() -> str:
    """Significance by critical values: 1.3580986 for the scaled KS distance, 12.591587 for chi-square with 6 degrees (7 years)."""
    ks = _ks_sql()
    cte = ks[: ks.index("    d AS (SELECT")]
    corr = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, abs(corr({a}, {b})) AS r FROM {SHIFT}" for a, b in itertools.permutations(SCOLS, 2))
    return f"""{cte} d AS (SELECT "column", p1, p2, max(abs(ca::DOUBLE / ta - cb::DOUBLE / tb)) * sqrt(any_value(ta)::DOUBLE * any_value(tb) / (any_value(ta) + any_value(tb))) AS s FROM r GROUP BY ALL),
    ch AS (SELECT "column" AS c, max(s) > 1.3580986 AS moves FROM d GROUP BY 1), rel AS ({_rel_sql()}),
    one AS (SELECT CASE WHEN a.moves THEN x ELSE y END AS src, CASE WHEN a.moves THEN y ELSE x END AS dst, strength AS weight, 'relation' AS evidence FROM rel JOIN ch a ON a.c = x JOIN ch b ON b.c = y WHERE statistic > 12.591587 AND a.moves <> b.moves),
    near AS (SELECT x AS src, y AS dst, r AS weight FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY r DESC, y) AS k FROM ({corr}) WHERE x IN (SELECT c FROM ch WHERE moves)) WHERE k <= 3 AND r > 0.3),
    n1 AS (SELECT * FROM near n WHERE NOT EXISTS (FROM one WHERE one.src = n.dst AND one.dst = n.src))
    SELECT * FROM one UNION ALL SELECT *, 'correlation' FROM n1 WHERE NOT (src > dst AND EXISTS (FROM n1 m WHERE m.src = n1.dst AND m.dst = n1.src)) AND NOT EXISTS (FROM one WHERE one.src = n1.src AND one.dst = n1.dst)"""


@query("nonstationary_graph", rounded_sql(_nonstationary_sql(), "src dst evidence", "weight", 4))
def nonstationary_graph(spark, sf):
    return rounded(shift.nonstationary_graph(shifted(spark, sf), SCOLS, "period"), 4)


def _chow_sql() -> str:
    parts = []
    for a, b in itertools.combinations(["disc", "mix", "qty"], 2):
        parts.append(f"""SELECT '{a}' AS x, '{b}' AS y, domains, n::BIGINT AS n, ((rp - rs) / ((domains - 1) * 2)) / (rs / (n - 2 * domains)) AS f, sv AS slope_variance, r2 AS mean_r2 FROM
        (SELECT count(*)::DOUBLE AS n, count(*) * (var_pop({b}) - power(covar_pop({a}, {b}), 2) / var_pop({a})) AS rp FROM {SHIFT}),
        (SELECT count(*) AS domains, sum(k * (vy - c * c / vx)) AS rs, var_pop(c / vx) AS sv, avg(c * c / (vx * vy)) AS r2 FROM (SELECT count(*) AS k, var_pop({a}) AS vx, var_pop({b}) AS vy, covar_pop({a}, {b}) AS c FROM {SHIFT} GROUP BY period))""")
    return " UNION ALL ".join(parts)


@query(
    "domain_invariance",
    rounded_sql(f"WITH c AS (SELECT *, {f_upper('f', '((domains - 1) * 2)', '(n - 2 * domains)')} AS p_value FROM ({_chow_sql()})) SELECT *, p_value > 0.05 AS invariant FROM c", "x y domains n invariant", "f p_value slope_variance mean_r2", 3),
)
def domain_invariance(spark, sf):
    return rounded(shift.domain_invariance(shifted(spark, sf), ["disc", "mix", "qty"], "period"), 3)


@query("anm_direction")
def anm_direction(spark, sf):
    df = _noisy(spark, sf).withColumn("curve", F.pow(F.col("qty") / 20, F.lit(3)) + F.col("net") / 20)
    return rounded(pairwise.anm_direction(df, "qty", "curve"))


IGCI = "(SELECT l_quantity + l_discount AS x, exp(l_quantity / 20.0) + l_tax AS y FROM lineitem)"


def _igci(spark, sf):
    return load(spark, sf, "lineitem").selectExpr("l_quantity + l_discount AS x", "exp(l_quantity / 20.0D) + l_tax AS y")


IGCI_OUT = "SELECT 'x' AS x, 'y' AS y, score, CASE WHEN score < 0 THEN 'x->y' ELSE 'y->x' END AS direction, least(1.0::DOUBLE, abs(score)) AS confidence FROM s"


@query(
    "igci_slope",
    rounded_sql(f"""WITH b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM {IGCI}), n AS (SELECT (x - a) / (b - a) * (1 - 2e-10) + 1e-10 AS x, (y - c) / (d - c) * (1 - 2e-10) + 1e-10 AS y FROM {IGCI}, b),
    d AS (SELECT lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM n WINDOW w AS (ORDER BY x, y)), m AS (SELECT min(dx) FILTER (dx > 0) AS m FROM d),
    s AS (SELECT avg(ln(abs(dy / CASE WHEN dx = 0 THEN m ELSE dx END))) FILTER (dy <> 0) AS score FROM d, m WHERE dx IS NOT NULL) {IGCI_OUT}""", "x y direction", "score confidence", 5),
)
def igci_slope(spark, sf):
    return rounded(pairwise.igci_slope(_igci(spark, sf), "x", "y"), 5)


@query(
    "igci_entropy",
    rounded_sql(f"""WITH b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM {IGCI}),
    hx AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT count(*) * 30.0::DOUBLE / (SELECT count(*) FROM lineitem) AS p FROM {IGCI}, b GROUP BY least(floor((x - a) * 30 / (b - a)), 29))),
    hy AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT count(*) * 30.0::DOUBLE / (SELECT count(*) FROM lineitem) AS p FROM {IGCI}, b GROUP BY least(floor((y - c) * 30 / (d - c)), 29))),
    s AS (SELECT hy.h - hx.h AS score FROM hx, hy) {IGCI_OUT}""", "x y direction", "score confidence", 5),
)
def igci_entropy(spark, sf):
    return rounded(pairwise.igci_entropy(_igci(spark, sf), "x", "y"), 5)


@query("igci_entropy_knn")
def igci_entropy_knn(spark, sf):
    return rounded(pairwise.igci_entropy_knn(_igci(spark, sf), "x", "y"), 5)


@query("kernel_graph")
def kernel_graph(spark, sf):
    return rounded(pairwise.kernel_graph(_noisy(spark, sf), ["disc", "price", "net", "tax"]))


# runs: every year is one run of the graph of a calendar month
RUNS = "runs AS (SELECT right(graph_id, 2) AS graph_id, left(graph_id, 4) AS run, src, dst FROM flows)"


def _runs(spark, sf):
    e = flows(spark, sf, False)
    return e.select(F.substring("graph_id", 6, 2).alias("graph_id"), F.substring("graph_id", 1, 4).alias("run"), "src", "dst")


@query(
    "ensemble_vote",
    rounded_sql(f"""WITH {CYC}, {RUNS}, t AS (SELECT graph_id, count(DISTINCT run) AS t FROM runs GROUP BY 1), s AS (SELECT graph_id, src, dst, count(DISTINCT run) / any_value(t)::DOUBLE AS share FROM runs JOIN t USING (graph_id) WHERE src <> dst GROUP BY 1, 2, 3),
    j AS (SELECT a.*, coalesce(b.share, 0) AS o FROM s a LEFT JOIN s b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src)
    SELECT graph_id, src, dst, share, CASE WHEN share >= 0.25 AND o >= 0.25 THEN 'conflict' WHEN share >= 0.25 THEN 'common' ELSE 'unique' END AS kind, share >= 0.25 AND o >= 0.25 AS bidirected FROM j WHERE share >= 0.25 OR o < 0.25""", "graph_id src dst kind bidirected", "share"),
)
def ensemble_vote(spark, sf):
    return rounded(ensemble.ensemble_vote(_runs(spark, sf), "run", 0.25))


@query(
    "method_agreement",
    rounded_sql(f"""WITH {DAG}, m AS (SELECT right(graph_id, 2) AS graph_id, 'year ' || left(graph_id, 4) AS method, src, dst, weight FROM flows)
    SELECT graph_id, src, dst, max(weight) AS weight, list_sort(list(DISTINCT method)) AS methods, count(DISTINCT method)::INT AS agreement FROM m GROUP BY 1, 2, 3""", "graph_id src dst methods agreement", "weight"),
)
def method_agreement(spark, sf):
    e = flows(spark, sf)
    m = e.select(F.substring("graph_id", 6, 2).alias("graph_id"), F.concat(F.lit("year "), F.substring("graph_id", 1, 4)).alias("method"), "src", "dst", "weight")
    return rounded(ensemble.method_agreement(m))
