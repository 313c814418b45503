"""Operators on edge tables (graph_id, src, dst, …) and node tables (graph_id, node, …).

One job serves every graph in the table. Loops store each round in the checkpoint folder and stop when nothing changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, row_bound, stored
from .groups import Groups, index_groups

G = "graph_id"
EDGE = [G, "src", "dst"]
NODE = [G, "node"]


def nodes_of(edges: DataFrame) -> DataFrame:
    """(graph_id, node) of every end of an edge."""
    return edges.select(G, F.explode(F.array("src", "dst")).alias("node")).distinct()


def _keep_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``nodes``."""
    one = nodes.select(G, F.col("node").alias("src"))
    two = nodes.select(G, F.col("node").alias("dst"))
    return edges.join(one, [G, "src"], "left_semi").join(two, [G, "dst"], "left_semi").select(edges.columns)


# ---------------------------------------------------------------- filters

def confidence_condition(threshold: float, comparison: str) -> Column:
    c = F.col("confidence")
    tests = {">=": c >= threshold, ">": c > threshold, "<=": c <= threshold, "<": c < threshold, "==": c == threshold}
    if comparison not in tests:
        raise ValueError(f"unknown comparison: {comparison}")
    return F.coalesce(tests[comparison], F.lit(comparison in (">=", ">", "==")))


def edges_by_confidence(edges: DataFrame, threshold: float, comparison: str = ">=") -> DataFrame:
    """Edges without confidence stay for >=, >, == and go for <, <=."""
    return edges.where(confidence_condition(threshold, comparison))


def type_condition(directed: bool, bidirected: bool, hidden_causes: bool) -> Column:
    bi, hid = F.coalesce("bidirected", F.lit(False)), F.coalesce("is_hidden_cause", F.lit(False))
    drop = F.lit(False)
    if not directed:
        drop = drop | (~bi & ~hid)
    if not bidirected:
        drop = drop | bi
    if not hidden_causes:
        drop = drop | hid
    return ~drop


def edges_by_type(edges: DataFrame, directed: bool = True, bidirected: bool = True, hidden_causes: bool = True) -> DataFrame:
    return edges.where(type_condition(directed, bidirected, hidden_causes))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, in_degree, out_degree); isolated nodes of ``nodes`` get zeros."""
    ends = edges.select(G, F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(G, "node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy(*NODE).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def nodes_by_role(
    edges: DataFrame, nodes: DataFrame | None = None, roots: bool = True, leaves: bool = True, intermediates: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(nodes kept, edges between them); an isolated node is a root and a leaf."""
    d = degrees(edges, nodes)
    root, leaf = F.col("in_degree") == 0, F.col("out_degree") == 0
    drop = F.lit(False)
    if not roots:
        drop = drop | root
    if not leaves:
        drop = drop | leaf
    if not intermediates:
        drop = drop | (~root & ~leaf)
    kept = d.where(~drop).select(*NODE)
    return kept, _keep_nodes(edges, kept)


def nodes_by_attribute(
    edges: DataFrame, nodes: DataFrame, attribute: str, values: Sequence, include: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Keep (or drop) nodes whose attribute is among ``values``."""
    among = F.coalesce(F.col(attribute).isin(list(values)), F.lit(False))
    kept = nodes.where(among if include else ~among)
    return kept, _keep_nodes(edges, kept.select(*NODE))


def apply_all_filters(
    edges: DataFrame,
    confidence: tuple[float, str] | None = None,
    types: Mapping[str, bool] | None = None,
    roles: Mapping[str, bool] | None = None,
    ends: DataFrame | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """All given filters one after the other, each on the result of the one before."""
    if confidence:
        edges = edges_by_confidence(edges, *confidence)
    if types:
        edges = edges_by_type(edges, **types)
    if ends is not None:
        edges = path_subgraph(edges, all_simple_paths(edges, ends, max_length))
    if roles:
        edges = nodes_by_role(edges, **roles)[1]
    return edges


# ---------------------------------------------------------------- reachability and structure

def _grow(parts: list[DataFrame]) -> DataFrame:
    """All of ``parts``; once there are many, they are written as one."""
    whole = reduce(DataFrame.unionByName, parts)
    if len(parts) > 8:
        whole = cut_lineage(whole.coalesce(max(1, whole.sparkSession.sparkContext.defaultParallelism)))
        parts[:] = [whole]
    return whole


def reach(edges: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """(graph_id, seed, node): nodes that can be reached from (or can reach) each seed over at least one edge; each round writes what is new."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = cut_lineage(edges.select(G, F.col(a).alias("node"), F.col(b).alias("next")).where(F.col("node") != F.col("next")).distinct())
    seeds = seeds.select(G, F.col("node").alias("seed"))
    delta = cut_lineage(seeds.withColumn("node", F.col("seed")).join(steps, NODE).select(G, "seed", F.col("next").alias("node")).distinct())
    parts = [delta]
    while not delta.isEmpty():
        found = delta.join(steps, NODE).select(G, "seed", F.col("next").alias("node")).distinct()
        delta = cut_lineage(found.join(_grow(parts), [G, "seed", "node"], "left_anti"))
        parts.append(delta)
    return reduce(DataFrame.unionByName, parts)


SMALL = 100_000  # rows of a round that are sent to every task instead of shuffling the table they meet


def _meet(few: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(F.broadcast(few) if row_bound(few, SMALL) <= SMALL else few, list(keys))


def reach_in_groups(members: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """``reach`` over the edges from each member of a group to the greater ones, read off the members (graph_id, group, node); no edge is written.

    A group is known by its lowest member reached so far (``backward``: the highest): all beyond it are reached. A round takes up the groups where that one moved.
    """
    nearest = F.max if backward else F.min

    def beyond(a: Column, b: Column) -> Column:
        return a < b if backward else a > b

    node, keys = F.col("node"), [G, "seed", "group"]
    delta = cut_lineage(seeds.select(G, F.col("node").alias("seed"), "node").distinct())
    parts, edge = [], []
    while not delta.isEmpty():
        touched = _meet(delta, members, NODE).groupBy(*keys).agg(nearest("node").alias("now"))
        if edge:
            old = reduce(DataFrame.unionByName, edge).groupBy(*keys).agg(nearest("now").alias("was"))
            touched = touched.join(old, keys, "left")
        else:
            touched = touched.withColumn("was", F.lit(None).cast(touched.schema["now"].dataType))
        moved = cut_lineage(touched.where(F.col("was").isNull() | beyond(F.col("was"), F.col("now"))))
        edge.append(moved.drop("was"))
        if len(edge) > 8:
            edge = [cut_lineage(reduce(DataFrame.unionByName, edge).groupBy(*keys).agg(nearest("now").alias("now")))]
        found = _meet(moved, members, [G, "group"]).where(beyond(node, F.col("now")) & (F.col("was").isNull() | ~beyond(node, F.col("was"))))
        found = found.select(G, "seed", "node").distinct()
        delta = cut_lineage(found.join(_grow(parts), [G, "seed", "node"], "left_anti") if parts else found)
        parts.append(delta)
    return reduce(DataFrame.unionByName, parts) if parts else seeds.select(G, F.col("node").alias("seed"), "node").limit(0)


def closure(edges: DataFrame) -> DataFrame:
    """(graph_id, ancestor, descendant) over at least one edge, by path doubling.

    A round joins what the last one found with all that is known, on both sides, so the length covered doubles: a chain of n nodes takes log2(n) rounds.
    Each round writes its delta only. Self loops add nothing; a node on a longer cycle is its own descendant.
    """
    keys = [G, "ancestor", "descendant"]
    delta = cut_lineage(edges.where("src != dst").select(G, F.col("src").alias("ancestor"), F.col("dst").alias("descendant")).distinct())
    parts = [delta]
    while not delta.isEmpty():
        known = _grow(parts)
        after = delta.select(G, "ancestor", F.col("descendant").alias("_m")).join(known.select(G, F.col("ancestor").alias("_m"), "descendant"), [G, "_m"]).select(*keys)
        before = known.select(G, "ancestor", F.col("descendant").alias("_m")).join(delta.select(G, F.col("ancestor").alias("_m"), "descendant"), [G, "_m"]).select(*keys)
        delta = cut_lineage(after.unionByName(before).distinct().join(known, keys, "left_anti"))
        parts.append(delta)
    return reduce(DataFrame.unionByName, parts)


SEEDS = 8  # of a graph; for more, groups are gone through for all seeds at once


def ancestors_descendants(edges: DataFrame | Groups, seeds: DataFrame | None = None) -> DataFrame:
    """(graph_id, ancestor, descendant) for the given nodes, or the whole transitive closure.

    With ``seeds``, ``edges`` may also be given by groups (graph_id, group, node), or as ``index_groups`` packs them: each member has an edge to the greater
    ones of its group.
    """
    if seeds is None:
        return closure(edges)
    walk = partial(reach, edges)
    if isinstance(edges, Groups):
        walk = edges.reach
    elif "group" in edges.columns:
        seeds = cut_lineage(seeds.select(*NODE).distinct())
        many = not seeds.groupBy(G).count().where(F.col("count") > SEEDS).isEmpty()
        walk = partial(reach_in_groups, edges) if many else index_groups(edges).reach
    down = walk(seeds).select(G, F.col("seed").alias("ancestor"), F.col("node").alias("descendant"))
    up = walk(seeds, backward=True).select(G, F.col("node").alias("ancestor"), F.col("seed").alias("descendant"))
    return down.unionByName(up).distinct()


def contract_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (graph_id, src, dst, ``steps``) with inner nodes of chains taken out, and where those went: (graph_id, node, ``head``, ``steps``).

    An inner node has one edge in and comes after a node with one edge out. Each finds the head of its chain by pointer doubling, so the rounds grow with the
    logarithm of the longest chain. Chains without a head (plain cycles) keep their nodes.
    """
    outs = edges.groupBy(G, F.col("src").alias("before")).agg(F.count(F.lit(1)).alias("o"))
    ins = edges.groupBy(G, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("before"))
    inner = ins.where("i = 1").join(outs.where("o = 1"), [G, "before"]).select(G, "node", F.col("before").alias("head"), F.lit(1).alias("steps"))
    now = cut_lineage(inner.withColumn("open", F.lit(True)))
    rounds = max(1, now.groupBy(G).count().agg(F.max("count")).first()[0] or 1).bit_length() + 1
    for _ in range(rounds):  # a pointer covers 2**round steps; one still open then goes round a cycle
        upper = now.select(G, F.col("node").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        now = cut_lineage(now.join(upper, [G, "head"], "left").select(G, "node", F.coalesce("_head", "head").alias("head"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_head").isNotNull().alias("open")))
        if now.where("open").isEmpty():
            break
    heads = now.where("not open").drop("open")
    loops = now.where("open").select(*NODE)
    moved = edges.select(*EDGE).join(heads.select(G, F.col("node").alias("src"), "head", "steps"), [G, "src"], "left")
    kept = moved.select(G, F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("steps", F.lit(0)) + 1).alias("steps")).join(heads.select(G, F.col("node").alias("dst")), [G, "dst"], "left_anti")
    return kept.select(*EDGE, "steps"), cut_lineage(heads.join(loops, NODE, "left_anti"))


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, level): longest distance from a root; null for nodes on or below a cycle.

    Chains are contracted first; then roots are peeled off, the level of a node being the greatest that an edge from a peeled node brought. A round writes the
    nodes it peels and their edges only.
    """
    every = cut_lineage(nodes_of(edges) if nodes is None else nodes_of(edges).unionByName(nodes.select(*NODE)).distinct())
    steps, inner = contract_chains(cut_lineage(edges.select(*EDGE).distinct()))
    steps = cut_lineage(steps)
    degree = steps.groupBy(G, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    left = every.join(inner, NODE, "left_anti").join(degree, NODE, "left")
    front = cut_lineage(left.where("n is null").select(*NODE, F.lit(0).alias("level")))
    waiting = cut_lineage(left.where("n is not null").select(*NODE, "n"))
    done, brought = [front], []
    while not front.isEmpty():
        new = front.withColumnRenamed("node", "src").join(steps, [G, "src"]).groupBy(G, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("level") + F.col("steps")).alias("_level"))
        new = cut_lineage(new)
        brought.append(new)
        if len(brought) > 8:
            brought = [cut_lineage(reduce(DataFrame.unionByName, brought).groupBy(*NODE).agg(F.sum("_n").alias("_n"), F.max("_level").alias("_level")))]
        # a node is free once all its edges have been brought; only nodes that got one this round can be
        total = reduce(DataFrame.unionByName, brought).join(new.select(*NODE), NODE, "left_semi").groupBy(*NODE).agg(F.sum("_n").alias("_n"), F.max("_level").alias("level"))
        front = cut_lineage(total.join(waiting, NODE).where("_n = n").select(*NODE, "level"))
        done.append(front)
    found = cut_lineage(reduce(DataFrame.unionByName, done))
    below = inner.join(found.select(G, F.col("node").alias("head"), F.col("level").alias("_level")), [G, "head"]).select(*NODE, (F.col("_level") + F.col("steps")).alias("level"))
    return every.join(found.unionByName(below), NODE, "left").select(*NODE, F.col("level").cast("int").alias("level"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges (graph_id, u, v) with ``u`` > ``v``: each ``u`` and its neighbours tied to the least of these."""
    least = edges.groupBy(G, "u").agg(F.min("v").alias("m"))
    moved = edges.join(least, [G, "u"]).where("v != m").select(G, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, component): the smallest node of the weakly connected component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the number of rounds grows with the logarithm of the
    component size, not with its diameter. The first step is a small-star over the edges as given; the edges of a round are stored as compressed columns.
    """
    linked = F.coalesce(F.col("src") != F.col("dst"), F.lit(False)) & F.col(G).isNotNull()
    # nodes without an edge to another; all others are found with their labels
    single = nodes_of(edges.where(~linked)) if nodes is None else nodes_of(edges.where(~linked)).unionByName(nodes.select(*NODE)).distinct()
    cur = stored(_small_star(edges.where(linked).select(G, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))))
    mark = None
    while True:
        both = cur.unionByName(cur.select(G, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(G, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, [G, "u"]).select(G, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        cur = stored(_small_star(stored(large)))
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64(G, "u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    labels = cur.groupBy(G, F.col("u").alias("node")).agg(F.min("v").alias("component"))
    found = labels.unionByName(cur.select(G, F.col("v").alias("node"), F.col("v").alias("component")).distinct())  # in the end a ``v`` leads its component
    return found.unionByName(single.join(found.select(*NODE), NODE, "left_anti").withColumn("component", F.col("node")))


def component_of(edges: DataFrame, graph_id, node) -> DataFrame:
    """Edges in the weakly connected component of one node."""
    comp = cut_lineage(weak_components(edges))
    mine = comp.where((F.col(G) == graph_id) & (F.col("node") == node)).select(G, "component")
    return _keep_nodes(edges, comp.join(mine, [G, "component"], "left_semi").select(*NODE))


# ---------------------------------------------------------------- paths

def all_simple_paths(edges: DataFrame, ends: DataFrame, max_length: int | None = None) -> DataFrame:
    """(graph_id, source, target, path, length) of the simple paths between the pairs of ``ends``.

    Partial paths grow only over nodes from which the target can still be reached.
    """
    pairs = cut_lineage(ends.select(G, "source", "target").where("source != target").distinct())
    steps = cut_lineage(edges.select(*EDGE).where("src != dst").distinct())
    useful = reach(steps, pairs.select(G, F.col("target").alias("node")).distinct(), backward=True)
    useful = useful.select(G, F.col("seed").alias("target"), F.col("node").alias("dst"))
    useful = cut_lineage(useful.unionByName(pairs.select(G, "target", F.col("target").alias("dst"))).distinct())
    front = pairs.select(G, "source", "target", F.array("source").alias("path"), F.col("source").alias("src"))
    done, length = None, 0
    while max_length is None or length < max_length:
        grown = (
            front.join(steps, [G, "src"]).where(~F.array_contains("path", F.col("dst"))).join(useful, [G, "target", "dst"], "left_semi")
            .select(G, "source", "target", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("src"))
        )
        grown = cut_lineage(grown)
        if grown.isEmpty():
            break
        length += 1
        hit = grown.where(F.col("src") == F.col("target")).select(G, "source", "target", "path", F.lit(length).alias("length"))
        done = hit if done is None else done.unionByName(hit)
        front = grown.where(F.col("src") != F.col("target"))
    if done is None:
        return pairs.where(F.lit(False)).select(G, "source", "target", F.array("source").alias("path"), F.lit(0).alias("length"))
    return cut_lineage(done)


def path_edges(paths: DataFrame) -> DataFrame:
    """One row per edge of a path: (…, path, step, src, dst)."""
    hops = F.transform(F.slice("path", 1, F.size("path") - 1), lambda s, i: F.struct(s.alias("src"), F.element_at("path", i + 2).alias("dst")))
    return paths.select("*", F.posexplode(hops).alias("step", "_h")).select(*paths.columns, "step", "_h.src", "_h.dst")


def path_subgraph(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges on any of the paths."""
    return edges.join(path_edges(paths).select(*EDGE).distinct(), EDGE, "left_semi").select(edges.columns)


def confounders_colliders(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(graph_id, source, target, node, role): common ancestors are confounders, common descendants colliders."""
    pairs = cut_lineage(ends.select(G, "source", "target").distinct())
    seeds = pairs.select(G, F.explode(F.array("source", "target")).alias("node")).distinct()
    out = None
    for role, backward in (("confounder", True), ("collider", False)):
        r = cut_lineage(reach(edges, seeds, backward))
        a = r.select(G, F.col("seed").alias("source"), "node")
        b = r.select(G, F.col("seed").alias("target"), "node")
        both = pairs.join(a, [G, "source"]).join(b, [G, "target", "node"])
        both = both.where((F.col("node") != F.col("source")) & (F.col("node") != F.col("target"))).withColumn("role", F.lit(role))
        out = both if out is None else out.unionByName(both)
    return out.select(G, "source", "target", "node", "role")


# ---------------------------------------------------------------- statistics and views

def graph_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per graph: sizes, density, degrees, acyclicity, components, self loops."""
    edges = cut_lineage(edges.select(*EDGE).distinct())
    deg = degrees(edges, nodes)
    per = deg.groupBy(G).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"), F.avg("in_degree").alias("avg_in_degree"),
        F.avg("out_degree").alias("avg_out_degree"), F.avg(F.col("in_degree") + F.col("out_degree")).alias("avg_degree"),
        F.max("in_degree").alias("max_in_degree"), F.max("out_degree").alias("max_out_degree"),
    )
    loops = edges.groupBy(G).agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"))
    dag = topological_levels(edges, nodes).groupBy(G).agg(F.bool_and(F.col("level").isNotNull()).alias("is_dag"))
    comp = weak_components(edges, nodes).groupBy(G).agg(F.count(F.when(F.col("component") == F.col("node"), 1)).alias("components"))
    n = F.col("nodes")
    out = per.join(loops, G, "left").join(dag, G).join(comp, G).na.fill(0, ["self_loops"])
    return out.withColumn("density", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(F.lit(0.0)))


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """(graph_id, node, degree, centrality, rank): degree / (n - 1)."""
    deg = degrees(edges, nodes).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    size = deg.groupBy(G).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(G).orderBy(F.desc("degree"), "node")
    if top is not None:  # every task hands on at most ``top`` nodes per graph
        deg = deg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    joined = deg.join(size, G)
    out = [G, "node", "degree", F.try_divide(F.col("degree"), F.col("_n") - 1).alias("centrality")]
    return joined.select(*out, "rank") if top is not None else joined.select(*out)


def graph_diff(base: DataFrame, other: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """(graph_id, kind, src, dst, change, details): edges and nodes added, removed, or changed (old → new)."""
    a = base.select(*EDGE, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in attributes])
    b = other.select(*EDGE, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in attributes])
    full = a.join(b, EDGE, "full_outer")
    changes = F.array_compact(F.array(*[
        F.when(
            ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")),
            F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"_a_{c}").cast("string"), F.lit("null")), F.lit(" → "), F.coalesce(F.col(f"_b_{c}").cast("string"), F.lit("null"))),
        )
        for c in attributes
    ])) if attributes else F.array().cast("array<string>")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changes) > 0, "changed")
    edges = full.select(
        G, F.when(change == "changed", "edge attribute").otherwise("edge").alias("kind"), "src", "dst", change.alias("change"),
        F.when(change == "changed", F.array_join(changes, ", ")).alias("details"),
    ).where(F.col("change").isNotNull())
    na, nb = nodes_of(base).withColumn("_a", F.lit(True)), nodes_of(other).withColumn("_b", F.lit(True))
    nodes = na.join(nb, NODE, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull()).select(
        G, F.lit("node").alias("kind"), F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"),
        F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"), F.lit(None).cast("string").alias("details"),
    )
    return edges.unionByName(nodes)


def adjacency_pivot(edges: DataFrame, names: Sequence[str], attribute: str | None = None) -> DataFrame:
    """(graph_id, node, one column per name): 0/1, or the attribute of the edge node → column."""
    value = F.lit(1.0) if attribute is None else F.col(attribute).cast("double")
    rows = nodes_of(edges).select(G, F.col("node").alias("src"))
    wide = edges.groupBy(G, "src").agg(*[F.max(F.when(F.col("dst") == n, value)).alias(n) for n in names])
    return rows.join(wide, [G, "src"], "left").na.fill(0.0, list(names)).withColumnRenamed("src", "node")


def adjacency_vs_corr(edges: DataFrame, corr: DataFrame) -> DataFrame:
    """(graph_id, x, y, r, forward, backward): the correlation of every pair beside its edges in both directions."""
    e = edges.select(*EDGE).distinct()
    fwd = e.select(G, F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(True).alias("forward"))
    bwd = e.select(G, F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(True).alias("backward"))
    out = corr.select(G, "x", "y", "r").join(fwd, [G, "x", "y"], "left").join(bwd, [G, "x", "y"], "left")
    return out.na.fill(False, ["forward", "backward"])


def lag_slices(edges: DataFrame, max_lag: int = 3) -> DataFrame:
    """(graph_id, time_lag, edges, nodes): edges per lag from 0 to ``max_lag``; a missing lag counts as 0."""
    lagged = edges.withColumn("time_lag", F.coalesce("time_lag", F.lit(0))).where(F.col("time_lag") <= max_lag)
    ends = lagged.select(G, "time_lag", F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = ends.groupBy(G, "time_lag").agg(F.count(F.lit(1)).alias("nodes"))
    return lagged.groupBy(G, "time_lag").agg(F.count(F.lit(1)).alias("edges")).join(n, [G, "time_lag"])


def edge_list(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, confidence, validated) for display; validated = has a verdict ``validation``."""
    valid = F.col("validation").isNotNull() if "validation" in edges.columns else F.lit(False)
    return edges.select(*EDGE, "confidence", valid.alias("validated"))


def shared_neighbours(edges: DataFrame, least: int = 2) -> DataFrame:
    """(graph_id, a, b, common, shared): node pairs with at least ``least`` (>= 2) common neighbours.

    Two common neighbours make a 4-cycle, so the pairs are read off 4-cycles. Wedges start at their highest-degree end
    (Chiba and Nishizeki 1985), which keeps a hub from emitting all pairs of its neighbours. Every common neighbour of a pair
    is in a 4-cycle with another one, so the cycles bring all of them.
    """
    ends = edges.where("src != dst").select(G, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = stored(ends)
    deg = ends.select(G, F.explode(F.array("a", "b")).alias("u")).groupBy(G, "u").agg(F.count(F.lit(1)).alias("d"))
    deg = stored(deg)
    ranked = ends.join(deg.select(G, F.col("u").alias("a"), F.col("d").alias("da")), [G, "a"]).join(deg.select(G, F.col("u").alias("b"), F.col("d").alias("db")), [G, "b"])
    ranked = stored(ranked)
    rise = F.struct("da", "a") < F.struct("db", "b")  # from a to b
    top = ranked.select(G, F.when(rise, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(rise, F.col("b")).otherwise(F.col("a")).alias("h"), F.greatest("da", "db").alias("dh"))
    low = ranked.select(G, F.inline(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("w"), F.col("db").alias("dw")), F.struct(F.col("b").alias("u"), F.col("a").alias("w"), F.col("da").alias("dw")),
    )))
    wedge = top.join(low, [G, "u"]).where(F.struct("dw", "w") < F.struct("dh", "h")).select(G, "h", "w", "u")
    same = Window.partitionBy(G, "h", "w")
    mids = stored(wedge.withColumn("_c", F.count(F.lit(1)).over(same)).where("_c >= 2").drop("_c"))
    # two middles of one pair share both of its ends, and the ends share the middles
    across = mids.join(mids.withColumnRenamed("u", "u2"), [G, "h", "w"]).where("u < u2").select(G, F.col("u").alias("a"), F.col("u2").alias("b"), F.explode(F.array("h", "w")).alias("c"))
    outer = mids.select(G, F.least("h", "w").alias("a"), F.greatest("h", "w").alias("b"), F.col("u").alias("c"))
    out = across.unionByName(outer).groupBy(G, "a", "b").agg(F.array_sort(F.collect_set("c")).alias("shared"))
    return out.select(G, "a", "b", F.size("shared").cast("long").alias("common"), "shared").where(F.col("common") >= least)


def fan_out(edges: DataFrame, least: int = 2) -> DataFrame:
    """(graph_id, node, children, parentless): nodes with several effects, and whether nothing causes them."""
    kids = edges.select(*EDGE).distinct().groupBy(G, F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("children"))
    kids = kids.where(F.size("children") >= least)
    caused = edges.select(G, F.col("dst").alias("node")).distinct().withColumn("_c", F.lit(True))
    return kids.join(caused, NODE, "left").select(G, "node", "children", F.col("_c").isNull().alias("parentless"))


def apply_domain_knowledge(
    edges: DataFrame, relationships: DataFrame, constraints: DataFrame, threshold: float = 0.7, flip: float = 0.8, cap: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """(edges, changes) after expert knowledge is laid over every graph that holds both nodes.

    direct: adds or updates source → target; above ``flip`` the opposite edge goes. indirect / correlation: where no edge
    joins the two, adds both directions as bidirected with capped confidence. forbidden_edge removes both directions,
    required_edge adds the edge and removes the opposite one. Direct relations are applied before indirect ones, then
    forbidden and required edges.
    """
    cols = [*EDGE, "weight", "confidence", "bidirected", "source_kind"]
    cur = cut_lineage(edges.select(*EDGE, "weight", "confidence", F.coalesce("bidirected", F.lit(False)).alias("bidirected"), F.lit("data").alias("source_kind")))
    nodes = cut_lineage(nodes_of(edges))

    def placed(k: DataFrame) -> DataFrame:
        """Knowledge rows per graph that has both nodes."""
        a = nodes.select(G, F.col("node").alias("src"))
        b = nodes.select(G, F.col("node").alias("dst"))
        return k.join(a, "src").join(b, [G, "dst"])

    def opposite(k: DataFrame) -> DataFrame:
        return k.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))

    changes = []
    rel = cut_lineage(placed(relationships.where(F.col("confidence") >= threshold).select(
        F.col("source").alias("src"), F.col("target").alias("dst"), F.col("confidence").alias("k"), "type")))
    direct = rel.where("type = 'direct'")
    flipped = opposite(direct.where(F.col("k") > flip))
    changes.append(cur.join(flipped, EDGE, "left_semi").select(*EDGE, F.lit("direction_changed").alias("change")))
    kept = cur.join(flipped, EDGE, "left_anti")
    j = kept.join(direct.select(*EDGE, "k"), EDGE, "full_outer")
    was, has = F.col("source_kind").isNotNull(), F.col("k").isNotNull()
    changes.append(j.where(has).select(*EDGE, F.when(was, "updated").otherwise("added").alias("change")))
    cur = cut_lineage(j.select(
        *EDGE, F.coalesce("weight", "k").alias("weight"), F.coalesce("k", "confidence").alias("confidence"),
        F.coalesce("bidirected", F.lit(False)).alias("bidirected"), F.when(has, "knowledge").otherwise("data").alias("source_kind"),
    ))
    soft = rel.where(F.col("type").isin("indirect", "correlation"))
    joined = cur.select(*EDGE).unionByName(opposite(cur))
    soft = soft.join(joined, EDGE, "left_anti")
    level = F.least(F.col("k"), F.lit(cap))
    both = soft.select(*EDGE, level.alias("k")).unionByName(soft.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), level.alias("k"))).distinct()
    both = both.select(*EDGE, F.col("k").alias("weight"), F.col("k").alias("confidence"), F.lit(True).alias("bidirected"), F.lit("knowledge").alias("source_kind"))
    changes.append(both.select(*EDGE, F.lit("added").alias("change")))
    cur = cut_lineage(cur.unionByName(both))
    con = constraints.select(F.col("source").alias("src"), F.col("target").alias("dst"), "type")
    bad = placed(con.where("type = 'forbidden_edge'")).select(*EDGE)
    bad = bad.unionByName(opposite(bad)).distinct()
    changes.append(cur.join(bad, EDGE, "left_semi").select(*EDGE, F.lit("removed").alias("change")))
    cur = cut_lineage(cur.join(bad, EDGE, "left_anti"))
    must = placed(con.where("type = 'required_edge'")).select(*EDGE).distinct().join(cur, EDGE, "left_anti")
    gone = opposite(must)
    changes.append(cur.join(gone, EDGE, "left_semi").select(*EDGE, F.lit("removed").alias("change")))
    changes.append(must.withColumn("change", F.lit("added")))
    new = must.select(*EDGE, F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit(False).alias("bidirected"), F.lit("knowledge").alias("source_kind"))
    cur = cur.join(gone, EDGE, "left_anti").unionByName(new)
    log = changes[0]
    for c in changes[1:]:
        log = log.unionByName(c)
    return cur.select(*cols), log
