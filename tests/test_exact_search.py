"""Sums over paths, closures, neighbour searches, grouped counts and readers, each against a plain version."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalmill.functions import cubes
from causalmill.operators import answers, association, graph, missing, outliers, paths, text, vectors
from causalmill.operators.discovery import constraint, score
from causalmill.sources import files, runlog


def edges_of(spark, edges, name="g"):
    return spark.createDataFrame([(name, *e) for e in edges], "graph_id string, src string, dst string, weight double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- paths

def all_paths(edges, s, t):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, 1.0 if w is None else w))
    found, todo = [], [([s], 1.0)]
    while todo:
        path, strength = todo.pop()
        if path[-1] == t:
            found.append((path, strength))
            continue
        todo += [(path + [b], strength * w) for b, w in out.get(path[-1], []) if b not in path]
    return found


def test_path_sums_brute_force(spark):
    rnd = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}", None if rnd.random() < 0.2 else float(rnd.normal())) for a, b in itertools.combinations(range(9), 2) if rnd.random() < 0.6]
    edges += [("z", "n0", 1.0), ("n8", "q", 1.0), ("p", "p", 2.0), ("loop1", "loop2", 1.0), ("loop2", "loop1", 1.0)]
    ends = spark.createDataFrame([("g", "n0", "n8"), ("g", "n1", "n7"), ("g", "n8", "n0"), ("g", "z", "q"), ("g", "n1", "n1")], "graph_id string, source string, target string")
    df = edges_of(spark, edges)
    sums = paths.path_sums(df, ends)
    got = {(r.source, r.target): r for r in paths.path_summary(sums).collect()}
    lengths = {(r.source, r.target, r.length): int(r.paths) for r in paths.path_lengths(sums).collect()}
    inner = {(r.source, r.target, r.node): r for r in paths.mediators(sums).collect()}
    seen_edges = set()
    for s, t in [("n0", "n8"), ("n1", "n7"), ("z", "q")]:
        found = all_paths(edges, s, t)
        if not found:
            assert (s, t) not in got
            continue
        seen_edges |= {(a, b) for p, _ in found for a, b in zip(p, p[1:])}
        total = sum(w for _, w in found)
        share = lambda v: v / total if total > 0 else v
        r = got[(s, t)]
        assert (int(r.paths), r.has_direct, int(r.indirect)) == (len(found), any(len(p) == 2 for p, _ in found), sum(len(p) > 2 for p, _ in found))
        assert (r.shortest, r.longest) == (min(len(p) for p, _ in found) - 1, max(len(p) for p, _ in found) - 1)
        assert r.mediators == sorted({n for p, _ in found for n in p[1:-1]}) and r.top_probability == pytest.approx(share(max(w for _, w in found)))
        for n in {len(p) - 1 for p, _ in found}:
            assert lengths[(s, t, n)] == sum(len(p) - 1 == n for p, _ in found)
        for n in r.mediators:
            through = [w for p, w in found if n in p[1:-1]]
            assert int(inner[(s, t, n)].paths_count) == len(through) and inner[(s, t, n)].importance == pytest.approx(share(sum(through)))
    assert {("n0", "n8"), ("z", "q")} <= set(got) <= {("n0", "n8"), ("n1", "n7"), ("z", "q")}
    assert {(r.src, r.dst) for r in paths.path_edges_of(df, ends).collect()} == seen_edges
    few = paths.listed_paths(df, ends, 3).where("source = 'n0'").collect()
    whole = all_paths(edges, "n0", "n8")
    assert sorted(r.path for r in few) == sorted(p for p, _ in whole if len(p) <= 4) and all(int(r.left_out) == sum(len(p) > 4 for p, _ in whole) and r.max_length == 3 for r in few)


def test_path_counts_that_nobody_could_list(spark):
    """A ladder of 12 rungs of 40 nodes has 40**12 paths; a cycle between the ends is refused."""
    ladder = [(f"a{i}", f"b{i}-{x}", 1.0) for i in range(12) for x in range(40)] + [(f"b{i}-{x}", f"a{i + 1}", 0.5) for i in range(12) for x in range(40)]
    ends = spark.createDataFrame([("g", "a0", "a12")], "graph_id string, source string, target string")
    r = paths.path_summary(paths.path_sums(edges_of(spark, ladder), ends)).first()
    assert int(r.paths) == 40**12 and r.shortest == r.longest == 24 and len(r.mediators) == 12 * 40 + 11 and r.top_probability == pytest.approx(40.0**-12)
    with pytest.raises(ValueError, match="cycle"):
        paths.path_sums(edges_of(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 1.0), ("c", "d", 1.0)]), spark.createDataFrame([("g", "a", "d")], "graph_id string, source string, target string"))
    assert paths.path_summary(paths.path_sums(edges_of(spark, ladder).limit(0), ends)).count() == 0


def brute_reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for s in out:
        todo = list(out[s])
        while todo:
            n = todo.pop()
            if (s, n) not in found:
                found.add((s, n))
                todo += out.get(n, ())
    return found


def test_closure_and_levels_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    edges = {(f"n{a}", f"n{b}") for a, b in rnd.integers(0, 40, (45, 2)) if a != b} | {(f"c{i}", f"c{i + 1}") for i in range(30)} | {("c30", "n1"), ("s", "s"), ("s", "t")}
    df = edges_of(spark, [(a, b, 1.0) for a, b in edges])
    want = brute_reach([e for e in edges if e[0] != e[1]])
    assert {(r.ancestor, r.descendant) for r in graph.ancestors_descendants(df).collect()} == want
    nodes = {n for e in edges for n in e}
    before = brute_reach(edges)
    bad = {n for n in nodes if (n, n) in before} | {b for a, b in before if (a, a) in before}
    level = {}

    def of(n):
        if n not in level:
            level[n] = max((of(a) + 1 for a, b in edges if b == n), default=0)
        return level[n]

    got = {r.node: r.level for r in graph.topological_levels(df).collect()}
    assert got == {n: None if n in bad else of(n) for n in nodes}
    # a long chain takes rounds by its logarithm
    writes = []
    real = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda d: writes.append(1) or real(d))
    chain = edges_of(spark, [(f"n{i:04d}", f"n{i + 1:04d}", 1.0) for i in range(1000)])
    assert {r.node: r.level for r in graph.topological_levels(chain).collect()} == {f"n{i:04d}": i for i in range(1001)}
    assert len(writes) < 40
    writes.clear()
    assert graph.closure(edges_of(spark, [(f"n{i:04d}", f"n{i + 1:04d}", 1.0) for i in range(300)])).count() == 300 * 301 // 2
    assert len(writes) < 16


# ---- neighbours

def test_knn_compares_fewer_blocks(spark):
    """Blocks that the triangle bound shuts out are not compared; their share grows with the table, the answer stays the plain one."""
    rng = np.random.default_rng(8)
    shares = []
    for n in (200, 800):
        x = rng.normal(size=(n, 3)).round(3)
        x[rng.random(n) < 0.2, 2] = np.nan
        df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(n))).select("id", "a", "b", F.when(~F.isnan("c"), F.col("c")).alias("c"))
        seen = {}
        got = missing.impute_knn(df, list("abc"), "id", 3, donors_max=10, counts=seen).toPandas().sort_values("id")["c"].to_numpy()
        known = np.flatnonzero(~np.isnan(x[:, 2]))
        for i in np.flatnonzero(np.isnan(x[:, 2])):
            d = ((x[known, :2] - x[i, :2]) ** 2).sum(axis=1)
            near = known[np.lexsort((x[known, 2], d))[:3]]
            assert got[i] == pytest.approx(x[near, 2].mean())
        shares.append(seen["compared"] / seen["possible"])
    assert shares[1] < 0.75 * shares[0] and shares[1] < 0.4


def test_dbscan_dense_cell_repeated_keys_and_counts(spark):
    rng = np.random.default_rng(6)
    pts = np.vstack([np.repeat(rng.normal(0, 0.001, (40, 2)), 8, axis=0), rng.normal(0, 0.01, (400, 2)), rng.normal(0.3, 0.3, (120, 2)), rng.uniform(-3, 3, (60, 2))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"]).assign(id=np.arange(len(pts)) // 2, n=range(len(pts))))
    z = (pts - pts.mean(axis=0)) / pts.std(axis=0)
    near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= 0.3**2
    for enough in (5, 60, 1000):
        got = outliers.outlier_dbscan(df, ["x", "y"], "id", 0.3, enough).toPandas().sort_values("n")
        core = near.sum(axis=1) >= enough
        assert len(got) == len(pts)
        np.testing.assert_array_equal(got["is_outlier"].to_numpy(), ~(core | (near & core[None]).any(axis=1)))


def test_isolation_forest_keeps_rows(spark):
    df = spark.range(240).select((F.col("id") / 2).cast("long").alias("k"), F.when(F.col("id") == 7, 90.0).when(F.col("id") == 8, None).otherwise(F.col("id") % 13).alias("v"), F.lit("x").alias("other"))
    out = outliers.outlier_isolation_forest(df, ["v"], "k", 0.02, trees=30).collect()
    assert len(out) == 240 and [r.v for r in out if r.is_outlier][:1] == [90.0] and [r.anomaly_score for r in out if r.v is None] == [None]
    assert outliers.outlier_isolation_forest(df.limit(0), ["v"], "k").count() == 0


@pytest.mark.parametrize("metric", ["sqeuclidean", "cosine"])
def test_inverted_file_is_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "RING", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 5)) * 4
    x = np.vstack([centres[i % 12] + rng.normal(size=5) * 0.2 for i in range(600)] + [centres[0]] * 100 + [np.zeros(5)])
    q = np.vstack([centres[:6] + 0.1, rng.normal(size=(4, 5)) * 5, centres[:1]])
    chunks = spark.createDataFrame([(i, 0, [float(v) for v in r], {"a": "b"}) for i, r in enumerate(x)], "document_id long, chunk_id int, embedding array<double>, metadata map<string,string>").repartition(4)
    asked = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id long, embedding array<double>")
    seen = {}
    got = text.vector_topk(asked, chunks, 7, -10.0, metric=metric, counts=seen).toPandas()
    for i in range(len(q)):
        if metric == "cosine":
            with np.errstate(invalid="ignore"):
                d = 1 - x @ q[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(q[i])
        else:
            d = ((x - q[i]) ** 2).sum(axis=1)
        order = sorted((round(v, 9), k) for k, v in enumerate(d) if not np.isnan(v))[:7]
        mine = got[got.query_id == i].sort_values("rank")
        np.testing.assert_allclose(mine["distance"], [v for v, _ in order], atol=1e-6)
        assert len(set(mine["document_id"])) == 7
    assert seen["met"] < 0.5 * seen["possible"]
    assert text.vector_topk(asked, chunks.limit(0), 3).count() == 0 and text.vector_topk(asked.limit(0), chunks, 3).count() == 0


# ---- grouped counts, searches over graphs

def test_counts_by_set(spark):
    df = spark.range(500).select(F.lit("g").alias("graph_id"), (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 4).cast("string").alias("b"), (F.col("id") % 7).cast("string").alias("c")).groupBy("graph_id", "a", "b", "c").agg(F.count("*").alias("_n"))
    sets = [["a"], ["a", "b"], ["c", "a"], ["a", "b", "c"]]
    asked = spark.createDataFrame([(s,) for s in sets], "s array<string>").select(cubes.set_id(F.col("s")).alias("_set"))
    got = cubes.counts_by_set(df, ["graph_id"], ["c", "a", "b"], asked).collect()
    pdf = pd.DataFrame({"a": [str(i % 3) for i in range(500)], "b": [str(i % 4) for i in range(500)], "c": [str(i % 7) for i in range(500)]})
    for s in sets:
        name = cubes.SEPARATOR.join(sorted(s))
        want = {k if isinstance(k, tuple) else (k,): v for k, v in pdf.groupby(sorted(s)).size().items()}
        assert {tuple(r["_v"][c] for c in sorted(s)): r.o for r in got if r["_set"] == name} == want
    assert cubes.counts_by_set(df, ["graph_id"], ["a", "b", "c"], asked.limit(0)).count() == 0


def test_tests_join_on_their_sets(spark):
    """No join of the count tests has the graph as its only key."""
    df = spark.range(300).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 2).alias("c"))
    tests = constraint.all_pairs(df, ["a", "b", "c"]).withColumn("given", F.array().cast("array<string>"))
    named = tests.withColumn("_set", cubes.set_id(F.concat("given", F.array("x", "y"))))
    assert named.select("_set").distinct().count() == 3
    assert constraint.count_test(df, ["a", "b", "c"])(tests).count() == 3


def test_greedy_search_scores_what_changed(spark):
    df = spark.range(4000).select(*[F.randn(i).alias(f"e{i}") for i in range(6)])
    df = df.select(F.col("e0").alias("a"), (F.col("e0") + F.col("e1")).alias("b"), (F.col("e0") + F.col("e1") + F.col("e2")).alias("c"), *[F.col(f"e{i}").alias(f"x{i}") for i in (3, 4, 5)])
    cols, seen = df.columns, []
    scorer = score.bic_scorer(df, cols)
    found = score.greedy_search(scorer, df.select(F.lit("all").alias("graph_id")).limit(1), cols, scored_per_round=seen).collect()
    assert {frozenset((r.src, r.dst)) for r in found} >= {frozenset("ab"), frozenset("bc")}
    assert seen[0] == 6 + 30 and all(n <= 12 for n in seen[1:])


# ---- ranks

def test_spearman_of_hot_values(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": np.where(rng.random(3000) < 0.5, 0.0, rng.normal(size=3000).round(1)), "y": rng.integers(0, 3, 3000).astype(float), "z": rng.normal(size=3000)})
    pdf.loc[:20, "z"] = np.nan
    pdf["y"] += pdf["x"].round()
    df = spark.createDataFrame(pdf).select("x", "y", F.when(~F.isnan("z"), F.col("z")).alias("z")).repartition(7)
    got = {(r.x, r.y): r for r in association.corr_spearman(df, ["x", "y", "z"]).collect()}
    want = pdf.dropna().rank().corr()
    for a, b in itertools.combinations("xyz", 2):
        assert got[(a, b)].r == pytest.approx(want.loc[a, b], abs=1e-12) and got[(a, b)].n == 2979
    one = association.with_average_rank(spark.createDataFrame([(5.0,)] * 50, "v double").repartition(5), "v", "r").collect()
    assert {r.r for r in one} == {25.5} and len(one) == 50
    assert association.with_average_rank(df.select("x").limit(0), "x", "r").count() == 0


# ---- chained imputation

def test_chained_imputation(spark):
    df = spark.range(3000).select((F.col("id") / 2).cast("long").alias("k"), F.randn(1).alias("a"), F.randn(2).alias("e"), F.lit("t").alias("other"), F.col("id")).withColumn("b", 2 * F.col("a") + 0.1 * F.col("e"))
    holed = df.select("k", "id", F.when(F.col("id") % 7 != 0, F.col("a")).alias("a"), F.when(F.col("id") % 5 != 0, F.col("b")).alias("b"), "other", F.lit(None).cast("double").alias("never"))
    out = missing.impute_multiple(holed, "k", ["a", "b", "never"], draws=3, rounds=3, trees=10)
    assert out.columns == holed.columns and out.count() == 3000 and out.where("a is null or b is null").count() == 0 and out.where("never is not null").count() == 0
    both = out.join(df.select("id", F.col("b").alias("truth")), "id").where("id % 5 = 0 and id % 7 != 0")
    assert both.agg(F.corr("b", "truth")).first()[0] > 0.95
    same = missing.impute_multiple(holed.repartition(5), "k", ["a", "b", "never"], draws=3, rounds=3, trees=10)
    assert rows_of(same.select("id", F.round("a", 9), F.round("b", 9))) == rows_of(out.select("id", F.round("a", 9), F.round("b", 9)))
    assert missing.impute_multiple(holed.limit(0), "k", ["a", "b"]).count() == 0


# ---- sources and answers

def test_json_shapes(spark, tmp_path):
    table = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    forms = {
        "records": table, "columns": {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}, "index": {"0": table[0], "1": table[1]},
        "split": {"columns": ["a", "b"], "index": [0, 1], "data": [[1, "x"], [2, None]]}, "lists": {"a": [1, 2], "b": ["x", None]}, "record": table[0],
    }
    for name, value in forms.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "t.json").write_text(json.dumps(value, indent=1))
        want = [("1", "x")] if name == "record" else [("1", "x"), ("2", None)]
        assert rows_of(files.read_json_oriented(spark, str(folder)).select("a", "b")) == sorted(want, key=repr), name
    docs = spark.createDataFrame([(json.dumps(v),) for v in forms.values()] + [("not json",), ("7",), ("[1, 2]",), (None,), ("{}",), ("[]",)], "v string")
    out = files.json_tables(docs, "v", schema=spark.createDataFrame([], "a long, b string, c double").schema)
    assert rows_of(out) == sorted([(1, "x", None)] * 6 + [(2, None, None)] * 5, key=repr)
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "t.json").write_text("\n".join(json.dumps(r) for r in table))
    assert files.read_json_oriented(spark, str(lines)).count() == 2


def test_knowledge_and_conflicts(spark):
    odd = [(1, None), (2, ""), (3, "[]"), (4, '{"variables": 3, "relationships": {"a": 1}, "constraints": [1, {"type": "timing"}], "background": ""}'), (5, "Direction: 1"), (6, "Confidence: 5\n Direction:2 \nDirection: 1")]
    df = spark.createDataFrame(odd, "id int, answer string")
    assert [(r.id, r.part, r.type) for r in answers.parse_knowledge_answers(df, ["id"]).collect()] == [(4, "constraints", "timing")]
    assert rows_of(answers.parse_conflict_answers(df, ["id"])) == [(6, "backward", 5)]


def test_stream_reads_a_file_once(spark, tmp_path):
    folder, store, progress = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "in" / "skip.csv").write_text("no")
    text.ingest_stream(spark, folder, store, progress, "1")
    (tmp_path / "in" / "sub" / "b.md").write_text(" \n")
    text.ingest_stream(spark, folder, store, progress, "2")
    out = text.ingest_stream(spark, folder, store, progress, "3")
    assert rows_of(out.select("document_id", "run", "chunk_id", "content")) == [("a.txt", "1", 0, "one"), ("a.txt", "1", 1, "two"), ("b.md", "2", 0, text.EMPTY)]


def test_observed_writes(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(3)
    out = files.write_table(df, str(tmp_path / "t.parquet")).first()
    assert (out.format, out.rows) == ("parquet", 1000) and out.bytes == sum(p.stat().st_size for p in (tmp_path / "t.parquet").glob("part-*"))
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "run_id long, src string, dst string")
    wrote = runlog.append_graph(spark.createDataFrame([(1,), (2,)], "run_id long"), edges, str(tmp_path / "runs"))
    assert wrote == {"runs": 2, "run_edges": 2} and math.isclose(runlog.read(spark, str(tmp_path / "runs"), "runs").agg(F.sum("nodes_count")).first()[0], 3)


def test_bulk_components_by_union_find(spark, sf):
    from causalmill.plans.queries import q05_graphs

    edges = [(r.graph_id, r.src, r.dst) for r in q05_graphs.bulk(spark, sf).collect()]
    assert len(edges) == spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", "o_custkey", "l_partkey").distinct().count()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for g, a, b in edges:
        x, y = sorted((find((g, a)), find((g, b))))
        root[y] = x  # the smaller name leads
    got = {(r.graph_id, r.node): (r.graph_id, r.component) for r in q05_graphs.weak_components_bulk(spark, sf).collect()}
    assert got == {n: find(n) for n in list(root)}
