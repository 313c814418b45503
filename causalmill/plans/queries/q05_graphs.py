"""Graphs: monthly trade between nations, and graphs over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.lineage import cut_lineage, stored
from ...operators import graph, hidden, paths
from ...operators.association import pair_stats
from ...operators.groups import index_groups
from ..registry import load, query, rounded, rounded_sql
from .q04_association import RICH, pairs_sql, rich

# per order month: from the nation of the supplier to that of the customer
FLOWS = """flows AS (SELECT graph_id, src, dst, weight, confidence, bidirected, is_hidden_cause, time_lag FROM (
SELECT strftime(o_orderdate, '%Y-%m') AS graph_id, sn.n_name AS src, cn.n_name AS dst, count(*) AS lines, count(*) / 50.0::DOUBLE AS weight,
CASE WHEN count(*) >= 3 THEN round(avg(l_quantity) / 50.0, 6) END AS confidence, max(l_linenumber) <= 4 AS bidirected, min(l_linenumber) >= 3 AS is_hidden_cause, least(min(l_linenumber) - 1, 3)::INT AS time_lag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey {where} GROUP BY 1, 2, 3))"""
DAG = FLOWS.format(where="WHERE sn.n_name < cn.n_name")
CYC = FLOWS.format(where="WHERE sn.n_name <> cn.n_name OR cn.n_regionkey = 0")


def flows(spark, sf, dag: bool = True):
    """The same edges by DataFrame operations; ``nation`` has 25 rows whatever the scale."""
    nation = load(spark, sf, "nation")
    cn = F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"), "n_regionkey"))
    sn = F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")))
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("graph_id"))
    cust = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supp = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(cn, "c_nationkey").join(sn, "s_nationkey")
    df = df.where(F.col("src") < F.col("dst")) if dag else df.where((F.col("src") != F.col("dst")) | (F.col("n_regionkey") == 0))
    n = F.count(F.lit(1))
    agg = df.groupBy("graph_id", "src", "dst").agg(
        n.alias("lines"), (n / 50.0).alias("weight"), F.when(n >= 3, F.round(F.avg("l_quantity") / 50.0, 6)).alias("confidence"),
        (F.max("l_linenumber") <= 4).alias("bidirected"), (F.min("l_linenumber") >= 3).alias("is_hidden_cause"),
        F.least(F.min("l_linenumber") - 1, F.lit(3)).cast("int").alias("time_lag"),
    )
    return cut_lineage(agg.drop("lines"))


def node_regions(spark, sf, edges):
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.nodes_of(edges).join(F.broadcast(n.select(F.col("n_name").alias("node"), F.col("r_name").alias("region"))), "node")


def ends(edges):
    return edges.groupBy("graph_id").agg(F.min("src").alias("source"), F.max("dst").alias("target"))


ENDS = "ends AS (SELECT graph_id, min(src) AS source, max(dst) AS target FROM flows GROUP BY 1)"
#: Longest path that ``all_simple_paths`` lists; the sums below know no limit, and tell how many paths it leaves out.
LISTED = 3
PATHS = f"""{ENDS}, walk AS (SELECT graph_id, source, target, [source] AS path, source AS cur FROM ends UNION ALL
SELECT w.graph_id, w.source, w.target, list_append(w.path, f.dst), f.dst FROM walk w JOIN flows f ON f.graph_id = w.graph_id AND f.src = w.cur WHERE w.cur <> w.target AND len(w.path) <= {LISTED} AND NOT list_contains(w.path, f.dst)),
paths AS (SELECT graph_id, source, target, path, (len(path) - 1)::INT AS length FROM walk WHERE cur = target AND len(path) > 1)"""
# sums over all paths, level by level, from the source and back from the target
SUMS = f"""{ENDS}, ahead AS (SELECT graph_id, source, target, source AS node, 0 AS length, 1::HUGEINT AS paths, 1::DOUBLE AS strength, 1::DOUBLE AS top FROM ends UNION ALL
SELECT a.graph_id, source, target, f.dst, length + 1, sum(paths)::HUGEINT, sum(strength * weight), max(top * weight) FROM ahead a JOIN flows f ON f.graph_id = a.graph_id AND f.src = a.node GROUP BY ALL),
back AS (SELECT graph_id, source, target, target AS node, 0 AS length, 1::HUGEINT AS paths, 1::DOUBLE AS strength FROM ends UNION ALL
SELECT b.graph_id, source, target, f.src, length + 1, sum(paths)::HUGEINT, sum(strength * weight) FROM back b JOIN flows f ON f.graph_id = b.graph_id AND f.dst = b.node GROUP BY ALL),
whole AS (SELECT graph_id, source, target, length, paths, strength, top FROM ahead WHERE node = target AND length > 0),
through AS (SELECT a.graph_id, a.source, a.target, a.node, sum(a.paths * b.paths) AS paths, sum(a.strength * b.strength) AS strength FROM ahead a JOIN back b ON a.graph_id = b.graph_id AND a.source = b.source AND a.target = b.target AND a.node = b.node GROUP BY ALL)"""
NODES = "nodes AS (SELECT graph_id, src AS node FROM flows UNION SELECT graph_id, dst FROM flows)"
EOUT = "graph_id, src, dst, confidence"


@query("edges_by_confidence", f"WITH {CYC} SELECT {EOUT} FROM flows WHERE confidence >= 0.5 OR confidence IS NULL")
def edges_by_confidence(spark, sf):
    return graph.edges_by_confidence(flows(spark, sf, False), 0.5, ">=").select("graph_id", "src", "dst", "confidence")


@query("edges_by_confidence_below", f"WITH {CYC} SELECT {EOUT} FROM flows WHERE confidence < 0.5")
def edges_by_confidence_below(spark, sf):
    return graph.edges_by_confidence(flows(spark, sf, False), 0.5, "<").select("graph_id", "src", "dst", "confidence")


@query("edges_by_type", f"WITH {CYC} SELECT graph_id, src, dst, bidirected, is_hidden_cause FROM flows WHERE NOT bidirected")
def edges_by_type(spark, sf):
    return graph.edges_by_type(flows(spark, sf, False), bidirected=False).select("graph_id", "src", "dst", "bidirected", "is_hidden_cause")


ROLES = "roles AS (SELECT n.graph_id, n.node, NOT EXISTS (FROM flows f WHERE f.graph_id = n.graph_id AND f.dst = n.node) AS root, NOT EXISTS (FROM flows f WHERE f.graph_id = n.graph_id AND f.src = n.node) AS leaf FROM nodes n)"


@query(
    "nodes_by_role",
    f"""WITH {DAG}, {NODES}, {ROLES}, k AS (SELECT * FROM roles WHERE NOT root)
    SELECT graph_id, src, dst FROM flows f WHERE EXISTS (FROM k WHERE k.graph_id = f.graph_id AND k.node = f.src) AND EXISTS (FROM k WHERE k.graph_id = f.graph_id AND k.node = f.dst)""",
)
def nodes_by_role(spark, sf):
    return graph.nodes_by_role(flows(spark, sf), roots=False)[1].select("graph_id", "src", "dst")


@query(
    "nodes_by_attribute",
    f"""WITH {DAG}, r AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT graph_id, src, dst FROM flows JOIN r a ON a.n_name = src JOIN r b ON b.n_name = dst WHERE a.r_name IN ('ASIA', 'EUROPE', 'AFRICA') AND b.r_name IN ('ASIA', 'EUROPE', 'AFRICA')""",
)
def nodes_by_attribute(spark, sf):
    e = flows(spark, sf)
    return graph.nodes_by_attribute(e, node_regions(spark, sf, e), "region", ["ASIA", "EUROPE", "AFRICA"])[1].select("graph_id", "src", "dst")


@query(
    "apply_all_filters",
    f"""WITH {CYC.replace('flows AS', 'raw AS')}, flows AS (SELECT * FROM raw WHERE (confidence > 0.45 OR confidence IS NULL) AND NOT is_hidden_cause), {NODES}, {ROLES}, k AS (SELECT * FROM roles WHERE NOT leaf)
    SELECT graph_id, src, dst FROM flows f WHERE EXISTS (FROM k WHERE k.graph_id = f.graph_id AND k.node = f.src) AND EXISTS (FROM k WHERE k.graph_id = f.graph_id AND k.node = f.dst)""",
)
def apply_all_filters(spark, sf):
    out = graph.apply_all_filters(flows(spark, sf, False), (0.45, ">"), {"hidden_causes": False}, {"leaves": False})
    return out.select("graph_id", "src", "dst")


@query(
    "weak_components",
    f"""WITH RECURSIVE {DAG}, und AS (SELECT graph_id, src AS a, dst AS b FROM flows UNION SELECT graph_id, dst, src FROM flows),
    r AS (SELECT graph_id, a AS node, a AS other FROM und UNION SELECT r.graph_id, r.node, u.b FROM r JOIN und u ON u.graph_id = r.graph_id AND u.a = r.other)
    SELECT graph_id, node, min(other) AS component FROM r GROUP BY 1, 2""",
)
def weak_components(spark, sf):
    return graph.weak_components(flows(spark, sf))


@query(
    "all_simple_paths",
    f"""WITH RECURSIVE {DAG}, {SUMS}, {PATHS.replace(ENDS + ", ", "")} SELECT graph_id, source, target, path, length, {LISTED} AS max_length, coalesce((SELECT sum(paths) FROM whole w WHERE w.graph_id = p.graph_id AND w.length > {LISTED}), 0)::BIGINT AS left_out FROM paths p""",
)
def all_simple_paths(spark, sf):
    e = flows(spark, sf)
    return paths.listed_paths(e, ends(e), LISTED).withColumn("left_out", F.col("left_out").cast("long"))


@query("path_lengths", f"WITH RECURSIVE {DAG}, {SUMS} SELECT graph_id, source, target, length, paths::BIGINT AS paths FROM whole")
def path_lengths(spark, sf):
    e = flows(spark, sf)
    return paths.path_lengths(paths.path_sums(e, ends(e))).withColumn("paths", F.col("paths").cast("long"))


@query(
    "path_subgraph",
    f"""WITH RECURSIVE {DAG}, {SUMS}, on_path AS (SELECT DISTINCT graph_id, node FROM through)
    SELECT f.graph_id, f.src, f.dst FROM flows f JOIN on_path a ON a.graph_id = f.graph_id AND a.node = f.src JOIN on_path b ON b.graph_id = f.graph_id AND b.node = f.dst""",
)
def path_subgraph(spark, sf):
    e = flows(spark, sf)
    return paths.path_edges_of(e, ends(e)).select("graph_id", "src", "dst")


@query(
    "path_summary",
    rounded_sql(f"""WITH RECURSIVE {DAG}, {SUMS}, m AS (SELECT graph_id, list(DISTINCT node ORDER BY node) AS mediators FROM through WHERE node NOT IN (source, target) GROUP BY 1)
    SELECT graph_id, source, target, sum(paths)::BIGINT AS paths, bool_or(length = 1) AS has_direct, coalesce(sum(paths) FILTER (length > 1), 0)::BIGINT AS indirect, min(length) AS shortest, max(length) AS longest,
    coalesce(any_value(mediators), []) AS mediators, max(top) / sum(strength) AS top_probability FROM whole LEFT JOIN m USING (graph_id) GROUP BY ALL""", "graph_id source target paths has_direct indirect shortest longest mediators", "top_probability"),
)
def path_summary(spark, sf):
    e = flows(spark, sf)
    out = paths.path_summary(paths.path_sums(e, ends(e)))
    return rounded(out.withColumns({"paths": F.col("paths").cast("long"), "indirect": F.col("indirect").cast("long")}))


@query(
    "mediators",
    rounded_sql(f"""WITH RECURSIVE {DAG}, {SUMS}, t AS (SELECT graph_id, sum(strength) AS total FROM whole GROUP BY 1)
    SELECT graph_id, source, target, node, paths::BIGINT AS paths_count, strength / total AS importance FROM through JOIN t USING (graph_id) WHERE node NOT IN (source, target)""", "graph_id source target node paths_count", "importance"),
)
def mediators(spark, sf):
    e = flows(spark, sf)
    return rounded(paths.mediators(paths.path_sums(e, ends(e))).withColumn("paths_count", F.col("paths_count").cast("long")))


CLOSURE = "closure AS (SELECT graph_id, src AS a, dst AS b FROM flows WHERE src <> dst UNION SELECT c.graph_id, c.a, f.dst FROM closure c JOIN flows f ON f.graph_id = c.graph_id AND f.src = c.b)"


@query(
    "confounders_colliders",
    f"""WITH RECURSIVE {DAG}, {CLOSURE}, ends AS (SELECT graph_id, min(dst) AS source, max(src) AS target FROM flows GROUP BY 1)
    SELECT e.graph_id, source, target, x.a AS node, 'confounder' AS role FROM ends e JOIN closure x ON x.graph_id = e.graph_id AND x.b = source JOIN closure y ON y.graph_id = e.graph_id AND y.b = target AND y.a = x.a WHERE x.a NOT IN (source, target)
    UNION ALL SELECT e.graph_id, source, target, x.b, 'collider' FROM ends e JOIN closure x ON x.graph_id = e.graph_id AND x.a = source JOIN closure y ON y.graph_id = e.graph_id AND y.a = target AND y.b = x.b WHERE x.b NOT IN (source, target)""",
)
def confounders_colliders(spark, sf):
    e = flows(spark, sf)
    return graph.confounders_colliders(e, e.groupBy("graph_id").agg(F.min("dst").alias("source"), F.max("src").alias("target")))


@query("ancestors_descendants", f"WITH RECURSIVE {DAG}, {CLOSURE} SELECT graph_id, a AS ancestor, b AS descendant FROM closure")
def ancestors_descendants(spark, sf):
    return graph.ancestors_descendants(flows(spark, sf))


LEVELS = f"""{NODES}, lv AS (SELECT n.graph_id, n.node, 0 AS level FROM nodes n WHERE NOT EXISTS (FROM flows f WHERE f.graph_id = n.graph_id AND f.dst = n.node)
UNION SELECT l.graph_id, f.dst, l.level + 1 FROM lv l JOIN flows f ON f.graph_id = l.graph_id AND f.src = l.node)"""


@query("topological_levels", f"WITH RECURSIVE {DAG}, {LEVELS} SELECT graph_id, node, max(level)::INT AS level FROM lv GROUP BY 1, 2")
def topological_levels(spark, sf):
    return graph.topological_levels(flows(spark, sf))


@query(
    "graph_stats",
    rounded_sql(f"""WITH RECURSIVE {CYC}, {NODES}, {CLOSURE}, und AS (SELECT graph_id, src AS a, dst AS b FROM flows UNION SELECT graph_id, dst, src FROM flows),
    r AS (SELECT graph_id, a AS node, a AS other FROM und UNION SELECT r.graph_id, r.node, u.b FROM r JOIN und u ON u.graph_id = r.graph_id AND u.a = r.other),
    comp AS (SELECT graph_id, count(DISTINCT c) AS components FROM (SELECT graph_id, node, min(other) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
    deg AS (SELECT n.graph_id, n.node, count(*) FILTER (f.dst = n.node) AS i, count(*) FILTER (f.src = n.node) AS o FROM nodes n JOIN flows f ON f.graph_id = n.graph_id GROUP BY 1, 2),
    d AS (SELECT graph_id, count(*) AS nodes, sum(o)::BIGINT AS edges, avg(i) AS avg_in_degree, avg(o) AS avg_out_degree, avg(i + o) AS avg_degree, max(i) AS max_in_degree, max(o) AS max_out_degree FROM deg GROUP BY 1),
    s AS (SELECT graph_id, count(*) FILTER (src = dst) AS self_loops FROM flows GROUP BY 1),
    cy AS (SELECT DISTINCT graph_id FROM closure WHERE a = b UNION SELECT graph_id FROM flows WHERE src = dst)
    SELECT d.*, self_loops, d.graph_id NOT IN (SELECT graph_id FROM cy) AS is_dag, components, edges / (nodes * (nodes - 1))::DOUBLE AS density FROM d JOIN s USING (graph_id) JOIN comp USING (graph_id)""",
                "graph_id nodes edges max_in_degree max_out_degree self_loops is_dag components", "avg_in_degree avg_out_degree avg_degree density"),
)
def graph_stats(spark, sf):
    return rounded(graph.graph_stats(flows(spark, sf, False)))


@query(
    "degree_centrality",
    rounded_sql(f"""WITH {DAG}, {NODES}, deg AS (SELECT n.graph_id, n.node, count(*) AS degree FROM nodes n JOIN flows f ON f.graph_id = n.graph_id AND n.node IN (f.src, f.dst) GROUP BY 1, 2)
    SELECT graph_id, node, degree, degree / (count(*) OVER (PARTITION BY graph_id) - 1)::DOUBLE AS centrality, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, node)::INT AS rank FROM deg QUALIFY rank <= 3""",
                "graph_id node degree rank", "centrality"),
)
def degree_centrality(spark, sf):
    return rounded(graph.degree_centrality(flows(spark, sf), top=3))


# the same months of the first and of the second half of the years
HALVES = """old AS (SELECT right(graph_id, 2) AS graph_id, src, dst, count(*) AS months, max(time_lag) AS time_lag FROM flows WHERE graph_id < '1998' GROUP BY 1, 2, 3),
new AS (SELECT right(graph_id, 2) AS graph_id, src, dst, count(*) AS months, max(time_lag) AS time_lag FROM flows WHERE graph_id >= '1998' GROUP BY 1, 2, 3)"""


@query(
    "graph_diff",
    f"""WITH {DAG}, {HALVES}, j AS (SELECT coalesce(o.graph_id, n.graph_id) AS graph_id, coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, o.months AS om, n.months AS nm, o.time_lag AS ot, n.time_lag AS nt
      FROM old o FULL JOIN new n ON o.graph_id = n.graph_id AND o.src = n.src AND o.dst = n.dst),
    on_ AS (SELECT graph_id, src AS node FROM old UNION SELECT graph_id, dst FROM old), nn AS (SELECT graph_id, src AS node FROM new UNION SELECT graph_id, dst FROM new)
    SELECT graph_id, CASE WHEN om IS NULL OR nm IS NULL THEN 'edge' ELSE 'edge attribute' END AS kind, src, dst, CASE WHEN om IS NULL THEN 'added' WHEN nm IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN om IS NOT NULL AND nm IS NOT NULL THEN concat_ws(', ', CASE WHEN om <> nm THEN 'months: ' || om || ' → ' || nm END, CASE WHEN ot <> nt THEN 'time_lag: ' || ot || ' → ' || nt END) END AS details
    FROM j WHERE om IS NULL OR nm IS NULL OR om <> nm OR ot <> nt
    UNION ALL SELECT graph_id, 'node', node, NULL, 'removed', NULL FROM (FROM on_ EXCEPT FROM nn) UNION ALL SELECT graph_id, 'node', node, NULL, 'added', NULL FROM (FROM nn EXCEPT FROM on_)""",
)
def graph_diff(spark, sf):
    e = flows(spark, sf).withColumn("old", F.col("graph_id") < "1998").withColumn("graph_id", F.substring("graph_id", 6, 2))
    per = cut_lineage(e.groupBy("old", "graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("months"), F.max("time_lag").alias("time_lag")))
    return graph.graph_diff(per.where("old").drop("old"), per.where("NOT old").drop("old"), ["months", "time_lag"])


def _nations(spark, sf):
    return [r.n_name for r in load(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]


NATION_NAMES = sorted(f"NATION_{i}" for i in range(25))


@query("adjacency_pivot", rounded_sql(
    f"WITH {DAG}, {NODES} SELECT n.graph_id, n.node, " + ", ".join(f"coalesce(max(CASE WHEN dst = '{n}' THEN weight END), 0) AS {n}" for n in NATION_NAMES)
    + " FROM nodes n LEFT JOIN flows f ON f.graph_id = n.graph_id AND f.src = n.node GROUP BY 1, 2", "graph_id node", " ".join(NATION_NAMES)))
def adjacency_pivot(spark, sf):
    return rounded(graph.adjacency_pivot(flows(spark, sf), _nations(spark, sf), "weight"))


COLGRAPH = [("qty", "volume"), ("price", "volume"), ("price", "net"), ("disc", "net"), ("qty", "boom")]
COL_SQL = "ce AS (SELECT f AS graph_id, e[1] AS src, e[2] AS dst FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT unnest([" + ", ".join(f"['{a}', '{b}']" for a, b in COLGRAPH) + "]) AS e))"
HCOLS = ["boom", "disc", "net", "price", "qty", "volume"]
CORR_SQL = "corr_long AS (" + pairs_sql(HCOLS, RICH, "l_returnflag AS graph_id, corr({a}, {b}) AS r", "GROUP BY l_returnflag") + ")"


def column_graph(spark, sf):
    flags = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("graph_id")).distinct()
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in COLGRAPH])
    return flags.select("graph_id", F.inline(pairs))


def column_corr(spark, sf):
    return cut_lineage(pair_stats(rich(spark, sf).withColumnRenamed("l_returnflag", "graph_id"), HCOLS, ["graph_id"]))


@query(
    "adjacency_vs_corr",
    rounded_sql(f"""WITH {COL_SQL}, {CORR_SQL} SELECT c.graph_id, x, y, r, EXISTS (FROM ce WHERE ce.graph_id = c.graph_id AND src = x AND dst = y) AS forward,
    EXISTS (FROM ce WHERE ce.graph_id = c.graph_id AND src = y AND dst = x) AS backward FROM corr_long c""", "graph_id x y forward backward", "r"),
)
def adjacency_vs_corr(spark, sf):
    return rounded(graph.adjacency_vs_corr(column_graph(spark, sf), column_corr(spark, sf)))


@query(
    "lag_slices",
    f"""WITH {DAG}, n AS (SELECT graph_id, time_lag, src AS node FROM flows UNION SELECT graph_id, time_lag, dst FROM flows), c AS (SELECT graph_id, time_lag, count(*) AS nodes FROM n GROUP BY 1, 2)
    SELECT graph_id, time_lag, count(*) AS edges, any_value(nodes) AS nodes FROM flows JOIN c USING (graph_id, time_lag) WHERE time_lag <= 2 GROUP BY 1, 2""",
)
def lag_slices(spark, sf):
    return graph.lag_slices(flows(spark, sf), 2)


@query("edge_list", f"WITH {DAG} SELECT graph_id, src, dst, confidence, CASE WHEN bidirected THEN true ELSE false END AS validated FROM flows")
def edge_list(spark, sf):
    e = flows(spark, sf).withColumn("validation", F.when(F.col("bidirected"), F.lit("ok")))
    return graph.edge_list(e)


@query(
    "shared_neighbours",
    f"""WITH {DAG}, u AS (SELECT graph_id, src AS a, dst AS c FROM flows UNION SELECT graph_id, dst, src FROM flows)
    SELECT x.graph_id, x.a, y.a AS b, count(*) AS common, list(x.c ORDER BY x.c) AS shared FROM u x JOIN u y ON x.graph_id = y.graph_id AND x.c = y.c AND x.a < y.a GROUP BY ALL HAVING count(*) >= 2""",
)
def shared_neighbours(spark, sf):
    return graph.shared_neighbours(flows(spark, sf))


@query(
    "fan_out",
    f"""WITH {DAG} SELECT f.graph_id, f.src AS node, list(f.dst ORDER BY f.dst) AS children, NOT EXISTS (FROM flows p WHERE p.graph_id = f.graph_id AND p.dst = f.src) AS parentless FROM flows f GROUP BY ALL HAVING count(*) >= 2""",
)
def fan_out(spark, sf):
    return graph.fan_out(flows(spark, sf))


# lines, from customer to part: as many nodes and edges as the tables have
BULK = """flows AS (SELECT DISTINCT l_returnflag AS graph_id, 'C' || o_custkey AS src, 'P' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def bulk(spark, sf, repeated: bool = False):
    """The edges; ``repeated``: as often as they occur."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = df.select("l_returnflag", "o_custkey", "l_partkey")
    keys = stored(keys if repeated else keys.distinct())  # keys are shorter than names
    return keys.select(F.col("l_returnflag").alias("graph_id"), F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"))


@query("weak_components_bulk")  # SQL would need all pairs of a component; tested against union-find
def weak_components_bulk(spark, sf):
    return graph.weak_components(bulk(spark, sf))


@query(
    "degree_centrality_bulk",
    rounded_sql(f"""WITH {BULK}, {NODES}, deg AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, src AS node FROM flows UNION ALL SELECT graph_id, dst FROM flows) GROUP BY 1, 2)
    SELECT graph_id, node, degree, degree / (count(*) OVER (PARTITION BY graph_id) - 1)::DOUBLE AS centrality, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, node)::INT AS rank FROM deg QUALIFY rank <= 10""",
                "graph_id node degree rank", "centrality"),
)
def degree_centrality_bulk(spark, sf):
    return rounded(graph.degree_centrality(bulk(spark, sf), top=10))


@query(
    "shared_neighbours_bulk",
    f"""WITH {BULK}, u AS (SELECT graph_id, src AS a, dst AS c FROM flows UNION SELECT graph_id, dst, src FROM flows)
    SELECT x.graph_id, x.a, y.a AS b, count(*) AS common, list(x.c ORDER BY x.c) AS shared FROM u x JOIN u y ON x.graph_id = y.graph_id AND x.c = y.c AND x.a < y.a GROUP BY ALL HAVING count(*) >= 2""",
)
def shared_neighbours_bulk(spark, sf):
    return graph.shared_neighbours(bulk(spark, sf))


@query(
    "ancestors_descendants_seeds",
    f"""WITH RECURSIVE {BULK}, hop AS (SELECT a.graph_id, a.dst AS src, b.dst FROM flows a JOIN flows b ON a.graph_id = b.graph_id AND a.src = b.src AND a.dst < b.dst),
    seeds AS (SELECT graph_id, min(src) AS node FROM hop GROUP BY 1),
    down AS (SELECT s.graph_id, s.node AS ancestor, h.dst AS descendant FROM seeds s JOIN hop h ON h.graph_id = s.graph_id AND h.src = s.node UNION SELECT d.graph_id, d.ancestor, h.dst FROM down d JOIN hop h ON h.graph_id = d.graph_id AND h.src = d.descendant),
    up AS (SELECT s.graph_id, h.src AS ancestor, s.node AS descendant FROM seeds s JOIN hop h ON h.graph_id = s.graph_id AND h.dst = s.node UNION SELECT d.graph_id, h.src, d.descendant FROM up d JOIN hop h ON h.graph_id = d.graph_id AND h.dst = d.ancestor)
    FROM down UNION FROM up""",
)
def ancestors_descendants_seeds(spark, sf):
    """Parts bought in bulk by the same customer, the lower name first; everything above and below the first part."""
    members = bulk(spark, sf, repeated=True).select("graph_id", F.col("src").alias("group"), F.col("dst").alias("node"))
    groups = index_groups(members)
    return graph.ancestors_descendants(groups, groups.lowest())


KNOW = """know AS (SELECT a.n_name AS source, b.n_name AS target, CASE a.n_regionkey WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.75 WHEN 2 THEN 0.95 ELSE 0.6 END AS k, CASE WHEN a.n_regionkey = 2 THEN 'indirect' ELSE 'direct' END AS type
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey WHERE a.n_regionkey <= 3),
cons AS (SELECT a.n_name AS source, b.n_name AS target, CASE WHEN a.n_nationkey < b.n_nationkey THEN 'forbidden_edge' ELSE 'required_edge' END AS type FROM nation a JOIN nation b ON (a.n_regionkey = 4 AND b.n_regionkey = 4 AND a.n_nationkey < b.n_nationkey) OR (a.n_regionkey = 3 AND b.n_regionkey = 3 AND a.n_nationkey > b.n_nationkey))"""


@query(
    "apply_domain_knowledge",
    rounded_sql(f"""WITH {DAG}, {NODES}, {KNOW}, rel AS (SELECT a.graph_id, source AS src, target AS dst, k, type FROM know JOIN nodes a ON a.node = source JOIN nodes b ON b.node = target AND b.graph_id = a.graph_id WHERE k >= 0.7),
    s1 AS (SELECT * FROM flows f WHERE NOT EXISTS (FROM rel r WHERE r.graph_id = f.graph_id AND r.type = 'direct' AND r.k > 0.8 AND r.src = f.dst AND r.dst = f.src)),
    s2 AS (SELECT coalesce(s1.graph_id, r.graph_id) AS graph_id, coalesce(s1.src, r.src) AS src, coalesce(s1.dst, r.dst) AS dst, coalesce(weight, k) AS weight, coalesce(k, confidence) AS confidence, coalesce(bidirected, false) AS bidirected,
      CASE WHEN k IS NULL THEN 'data' ELSE 'knowledge' END AS source_kind FROM s1 FULL JOIN (FROM rel WHERE type = 'direct') r ON r.graph_id = s1.graph_id AND r.src = s1.src AND r.dst = s1.dst),
    soft AS (SELECT * FROM rel r WHERE type = 'indirect' AND NOT EXISTS (FROM s2 WHERE s2.graph_id = r.graph_id AND ((s2.src = r.src AND s2.dst = r.dst) OR (s2.src = r.dst AND s2.dst = r.src)))),
    s3 AS (SELECT * FROM s2 UNION ALL SELECT graph_id, src, dst, least(k, 0.7), least(k, 0.7), true, 'knowledge' FROM soft UNION ALL SELECT graph_id, dst, src, least(k, 0.7), least(k, 0.7), true, 'knowledge' FROM soft),
    con AS (SELECT a.graph_id, source AS src, target AS dst, type FROM cons JOIN nodes a ON a.node = source JOIN nodes b ON b.node = target AND b.graph_id = a.graph_id),
    s4 AS (SELECT * FROM s3 WHERE NOT EXISTS (FROM con c WHERE c.type = 'forbidden_edge' AND c.graph_id = s3.graph_id AND ((c.src = s3.src AND c.dst = s3.dst) OR (c.src = s3.dst AND c.dst = s3.src)))),
    must AS (SELECT * FROM con c WHERE type = 'required_edge' AND NOT EXISTS (FROM s4 WHERE s4.graph_id = c.graph_id AND s4.src = c.src AND s4.dst = c.dst))
    SELECT * FROM s4 WHERE NOT EXISTS (FROM must m WHERE m.graph_id = s4.graph_id AND m.src = s4.dst AND m.dst = s4.src)
    UNION ALL SELECT graph_id, src, dst, 1.0, 1.0, false, 'knowledge' FROM must""", "graph_id src dst bidirected source_kind", "weight confidence"),
)
def apply_domain_knowledge(spark, sf):
    n = load(spark, sf, "nation")
    a = n.select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("ak"), F.col("n_regionkey").alias("r"))
    b = n.select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("bk"), F.col("n_regionkey").alias("r"))
    pairs = a.join(b, "r")
    level = F.when(F.col("r") == 0, 0.9).when(F.col("r") == 1, 0.75).when(F.col("r") == 2, 0.95).otherwise(0.6)
    rel = pairs.where("r <= 3 AND ak > bk").select("source", "target", level.alias("confidence"), F.when(F.col("r") == 2, "indirect").otherwise("direct").alias("type"))
    con = pairs.where("(r = 4 AND ak < bk) OR (r = 3 AND ak > bk)").select("source", "target", F.when(F.col("ak") < F.col("bk"), "forbidden_edge").otherwise("required_edge").alias("type"))
    return rounded(graph.apply_domain_knowledge(flows(spark, sf), rel, con)[0])


@query(
    "hidden_by_correlation",
    rounded_sql(f"""WITH {COL_SQL}, {CORR_SQL} SELECT graph_id, 'correlation' AS method, [x, y] AS affects, (abs(r) - 0.5) / (1 - 0.5) AS confidence, abs(r) AS detail FROM corr_long c
    WHERE abs(r) > 0.5 AND NOT EXISTS (FROM ce WHERE ce.graph_id = c.graph_id AND ((src = x AND dst = y) OR (src = y AND dst = x)))""", "graph_id method affects", "confidence detail"),
)
def hidden_by_correlation(spark, sf):
    return rounded(hidden.hidden_by_correlation(column_graph(spark, sf), column_corr(spark, sf), 0.5))


TCOLS = ["disc", "qty", "tax", "wide", "z"]
TSRC = "(SELECT l_returnflag AS graph_id, l_discount * 100 AS disc, l_quantity AS qty, l_tax * 100 AS tax, l_quantity + l_discount * 50 AS wide, l_quantity * 2 - l_tax * 100 AS z FROM lineitem)"


def _tetrad_sql() -> str:
    import itertools

    covs = ", ".join(f"covar_samp({a}, {b}) AS c_{a}_{b}" for a in TCOLS for b in TCOLS)
    parts = []
    for a, b, c, d in itertools.combinations(TCOLS, 4):
        q = [a, b, c, d]
        mean = "(" + " + ".join(f"abs(c_{i}_{j})" for i in q for j in q) + ") / 16"
        t1, t2, t3 = f"c_{a}_{c} * c_{b}_{d}", f"c_{a}_{d} * c_{b}_{c}", f"c_{a}_{b} * c_{c}_{d}"
        parts.append(f"SELECT graph_id, ['{a}', '{b}', '{c}', '{d}'] AS affects, abs({t1} - {t2}) AS d1, abs({t3} - {t1}) AS d2, abs({t3} - {t2}) AS d3, 0.1 * {mean} AS lim FROM cv")
    return f"""WITH cv AS (SELECT graph_id, {covs} FROM {TSRC} GROUP BY 1), t AS ({' UNION ALL '.join(parts)})
    SELECT graph_id, 'tetrad' AS method, affects, 0.7::DOUBLE AS confidence, CASE WHEN d1 < lim THEN d1 WHEN d2 < lim THEN d2 ELSE d3 END AS detail FROM t WHERE (d1 < lim)::INT + (d2 < lim)::INT + (d3 < lim)::INT = 1"""


@query("hidden_by_tetrad", rounded_sql(_tetrad_sql(), "graph_id method affects", "confidence detail"))
def hidden_by_tetrad(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS graph_id", "l_discount * 100 AS disc", "l_quantity AS qty", "l_tax * 100 AS tax", "l_quantity + l_discount * 50 AS wide", "l_quantity * 2 - l_tax * 100 AS z"
    )
    return rounded(hidden.hidden_by_tetrad(df, TCOLS, ["graph_id"]))


# qty and price both cause volume; the collider check also sees volume and boom as parents of one more node
COL2 = COL_SQL.replace("ce AS", "ce0 AS") + ", ce AS (SELECT * FROM ce0 WHERE NOT (src = 'qty' AND dst = 'boom') UNION ALL SELECT DISTINCT graph_id, 'net', 'tail' FROM ce0 UNION ALL SELECT DISTINCT graph_id, 'boom', 'tail' FROM ce0 UNION ALL SELECT DISTINCT graph_id, 'volume', 'tail' FROM ce0)"


def _with_tail(e):
    more = e.select("graph_id").distinct().select("graph_id", F.explode(F.array(F.lit("net"), F.lit("boom"), F.lit("volume"))).alias("src"), F.lit("tail").alias("dst"))
    return cut_lineage(e.where("NOT (src = 'qty' AND dst = 'boom')").unionByName(more))


COLLIDER = """SELECT DISTINCT c.graph_id, 'collider' AS method, [c.x, c.y] AS affects, (abs(r) - 0.1) / (1 - 0.1) AS confidence, abs(r) AS detail FROM corr_long c JOIN ce a ON a.graph_id = c.graph_id AND a.src = c.x JOIN ce b ON b.graph_id = c.graph_id AND b.src = c.y AND b.dst = a.dst
WHERE abs(r) > 0.1 AND NOT EXISTS (FROM ce WHERE ce.graph_id = c.graph_id AND ((ce.src = c.x AND ce.dst = c.y) OR (ce.src = c.y AND ce.dst = c.x)))
AND NOT EXISTS (FROM ce p JOIN ce q ON p.graph_id = q.graph_id AND p.src = q.src WHERE p.graph_id = c.graph_id AND p.dst = c.x AND q.dst = c.y)"""


@query("hidden_by_collider", rounded_sql(f"WITH {COL2}, {CORR_SQL} {COLLIDER}", "graph_id method affects", "confidence detail"))
def hidden_by_collider(spark, sf):
    return rounded(hidden.hidden_by_collider(_with_tail(column_graph(spark, sf)), column_corr(spark, sf), 0.1))


@query(
    "hidden_merge",
    rounded_sql(f"""WITH {COL2}, {CORR_SQL}, col AS ({COLLIDER}),
    cor AS (SELECT graph_id, 'correlation' AS method, [x, y] AS affects, (abs(r) - 0.3) / (1 - 0.3) AS confidence, abs(r) AS detail FROM corr_long c WHERE abs(r) > 0.3 AND NOT EXISTS (FROM ce WHERE ce.graph_id = c.graph_id AND ((src = x AND dst = y) OR (src = y AND dst = x)))),
    u AS (SELECT *, row_number() OVER (PARTITION BY graph_id, affects ORDER BY confidence DESC, method) AS rk FROM (FROM col UNION ALL FROM cor))
    SELECT graph_id, 'Hidden_' || upper(method[1]) || method[2:] || '_' || array_to_string(affects, '_') AS src, unnest(affects) AS dst, confidence, true AS is_hidden_cause FROM u WHERE rk = 1""", "graph_id src dst is_hidden_cause", "confidence"),
)
def hidden_merge(spark, sf):
    e, c = _with_tail(column_graph(spark, sf)), column_corr(spark, sf)
    return rounded(hidden.hidden_merge([hidden.hidden_by_collider(e, c, 0.1), hidden.hidden_by_correlation(e, c, 0.3)])[1])
