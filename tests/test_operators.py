"""Operators without a SQL twin: brute force on small tables, known truth on synthetic ones."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalmill.operators import answers, association, effects, graph, missing, outliers, scaling, text, vectors, windows
from causalmill.operators.discovery import constraint, lingam, pairwise, score, temporal
from causalmill.plans.steps import run_steps
from causalmill.sources import databases, files
from causalmill.sources.synthetic import synthetic_scm


def test_kendall_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 200), rng.integers(0, 15, 200)
    y = y + x // 2
    got = association.corr_kendall(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").first()
    disc = conc = tx = ty = 0
    for i, j in itertools.combinations(range(200), 2):
        s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        disc, conc = disc + (s < 0), conc + (s > 0)
        tx, ty = tx + (x[i] == x[j]), ty + (y[i] == y[j])
    n0 = 200 * 199 / 2
    assert got.discordant == disc
    assert got.tau == pytest.approx((conc - disc) / np.sqrt((n0 - tx) * (n0 - ty)))


def test_pair_stats_routes_agree(spark):
    rng = np.random.default_rng(5)
    x = pd.DataFrame(rng.normal(size=(200, 5)), columns=list("abcde"))
    x = x.mask(rng.random(x.shape) < 0.2)
    df = spark.createDataFrame(x).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcde"])
    ref = x.corr()
    for cols in ("abc", "abcde"):
        for r in association.pair_stats(df, list(cols)).collect():
            assert r.r == pytest.approx(ref.loc[r.x, r.y])
            assert r.n == (x[r.x].notna() & x[r.y].notna()).sum()


def test_logistic_batch_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.8 * x - 2.0)))
    m = association.logistic_batch(spark.createDataFrame(pd.DataFrame({"x": x, "y": y.astype(int)})), [(F.col("y"), F.col("x"))])[0]
    assert m["coefficient"] == pytest.approx(0.8, abs=0.1) and m["intercept"] == pytest.approx(-2.0, abs=0.3)
    auc = association.logistic_auc(spark.createDataFrame(pd.DataFrame({"x": x, "y": y.astype(int)})), "x", "y").first().auc
    pos, neg = x[y], x[~y]
    assert auc == pytest.approx((pos[:, None] > neg[None, :]).mean(), abs=1e-9)


def test_hsic_finds_dependence(spark):
    df = spark.range(3000).select(F.randn(1).alias("x"), F.randn(2).alias("z")).withColumn("y", F.col("x") * F.col("x") + 0.1 * F.col("z"))
    assert not association.hsic_test(df, "x", "y").first().independent
    assert association.hsic_test(df, "x", "z").first().p_value > 0.01
    for kernel in ("laplacian", "polynomial"):
        assert not association.hsic_test(df, "x", "y", kernel).first().independent


def test_knn_fill_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)).round(2)
    hole = rng.random(x.shape) < 0.15
    x[hole] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(60))
    df = spark.createDataFrame(pdf).select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    for block in (7, 1000):
        got = missing.impute_knn(df, list("abc"), "id", 5, donors_max=block).toPandas().sort_values("id")[list("abc")].to_numpy()
        for i, j in zip(*np.nonzero(hole)):
            both = ~np.isnan(x) & ~np.isnan(x[i])
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.sqrt(np.where(both, (np.nan_to_num(x) - np.nan_to_num(x[i])) ** 2, 0).sum(axis=1) * 3 / both.sum(axis=1))
            ok = [k for k in range(60) if not np.isnan(x[k, j]) and both[k].any()]
            if ok:
                near = sorted(ok, key=lambda k: (d[k], x[k, j]))[:5]
                assert got[i, j] == pytest.approx(x[near, j].mean())


def test_dbscan_noise_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(0, 0.2, (200, 2)), rng.normal(3, 0.3, (40, 2)), rng.uniform(-6, 8, (40, 2))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"]).assign(id=range(len(pts))))
    got = outliers.outlier_dbscan(df, ["x", "y"], "id", 0.25, 5).toPandas().sort_values("id")["is_outlier"].to_numpy()
    z = (pts - pts.mean(axis=0)) / pts.std(axis=0)
    near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= 0.25**2
    core = near.sum(axis=1) >= 5
    np.testing.assert_array_equal(got, ~(core | (near & core[None]).any(axis=1)))


def test_isolation_forest_draws_each_tree_from_all_rows(spark):
    """A table far longer than all samples: a hash says into how many trees a row goes, others into which; a tree takes the rows of least hash."""
    df = spark.range(3000).select("id", F.rand(3).alias("x")).persist()
    x = {r.id: r.x for r in df.collect()}
    hashes = df.select("id", F.xxhash64("id", "x", F.lit(42)).alias("u"), *[F.xxhash64("id", "x", F.lit(t), F.lit(43)).alias(f"h{t}") for t in (0, 1)]).collect()
    p = 1.3 * 64 / 3000
    depth, drawn = np.zeros(len(x)), {0: [], 1: []}
    for r in hashes:
        u = r.u % (1 << 40) / (1 << 40)
        many = (u >= (1 - p) ** 2) + (u >= (1 - p) ** 2 + 2 * p * (1 - p))
        for h, t in sorted([(r.h0, 0), (r.h1, 1)])[:many]:
            drawn[t].append((h, r.id))
    for t in (0, 1):
        rows = sorted(drawn[t])[:64]
        nodes = outliers._grow_tree(np.array([[x[i]] for _, i in rows]), np.random.default_rng(42 + t), 6)
        for i, v in x.items():
            at = 0
            while nodes[at][0] >= 0:
                at = nodes[at][2] if v < nodes[at][1] else nodes[at][3]
            depth[i] += nodes[at][1]
    norm = float(outliers._average_path(np.array(64)))
    for r in outliers.outlier_isolation_forest(df, ["x"], "id", trees=2, sample=64).collect():
        assert abs(r.anomaly_score - 2.0 ** (-depth[r.id] / 2 / norm)) < 0.02


def test_isolation_forest_finds_far_points(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 1, (2000, 2)), [[9, 9], [-8, 9], [10, -9]]])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"]).assign(id=range(len(pts))))
    out = outliers.outlier_isolation_forest(df, ["x", "y"], "id", 0.01, trees=50).where("id >= 2000")
    assert out.where("is_outlier").count() == 3


def test_imputation_models(spark):
    df = spark.range(2000).withColumn("a", F.randn(1)).withColumn("b", 3 * F.col("a") + 1 + 0.01 * F.randn(2))
    holed = df.withColumn("h", F.when(F.col("id") % 5 != 0, F.col("b")))
    for out in (missing.impute_regression(holed, "h", ["a"]), missing.impute_causal(holed.drop("b"), [("a", "h")], ["a", "h"]).join(df.select("id", "b"), "id")):
        assert out.agg(F.max(F.abs(F.col("h") - F.col("b")))).first()[0] < 0.1
    many = missing.impute_multiple(holed.drop("b"), "id", ["a", "h"], draws=2, trees=5)
    assert many.where("h IS NULL").count() == 0


def test_missingness_kinds(spark):
    df = spark.range(4000).withColumn("x", F.randn(1)).withColumn("y", F.randn(3)).withColumn("u", F.rand(9))
    df = df.select("x", F.when(F.col("x") < 0, F.col("y")).alias("mar"), F.when(F.col("u") > 0.3, F.col("y")).alias("mcar"))
    kinds = {r["column"]: r["kind"] for r in missing.missingness_type(df, ["x", "mar", "mcar"], 0.001).collect()}
    assert kinds["x"] == "NONE" and kinds["mar"] == "MAR" and kinds["mcar"] == "MCAR"


def _graphs(spark, edges):
    return spark.createDataFrame([("g", *e) for e in edges], "graph_id string, src string, dst string")


def test_graph_shapes(spark):
    cyc = _graphs(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")])
    lv = {r.node: r.level for r in graph.topological_levels(cyc).collect()}
    assert lv == {"a": None, "b": None, "c": None, "d": None, "x": 0, "y": 1}
    st = graph.graph_stats(cyc).first()
    assert (st.nodes, st.edges, st.components, st.is_dag, st.self_loops) == (6, 5, 2, False, 0)
    ends = spark.createDataFrame([("g", "a", "d"), ("g", "a", "y")], "graph_id string, source string, target string")
    assert [r.path for r in graph.all_simple_paths(cyc, ends).collect()] == [["a", "b", "c", "d"]]
    empty = cyc.limit(0)
    assert graph.weak_components(empty).count() == 0 and graph.graph_stats(empty).count() == 0
    chain = _graphs(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)])
    assert {r.component for r in graph.weak_components(chain).collect()} == {"n00"}


def test_shared_neighbours_with_hub(spark):
    rng = np.random.default_rng(1)
    edges = {("hub", f"v{i}") for i in range(30)} | {(f"v{a}", f"w{b}") for a, b in rng.integers(0, 12, (40, 2))}
    got = {(r.a, r.b): tuple(r.shared) for r in graph.shared_neighbours(_graphs(spark, edges)).collect()}
    nb = {}
    for a, b in edges:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    want = {(a, b): tuple(sorted(nb[a] & nb[b])) for a, b in itertools.combinations(sorted(nb), 2) if len(nb[a] & nb[b]) >= 2}
    assert got == want


EDGES = [(0, 2, 1.2), (1, 2, -0.9), (2, 3, 1.0)]


def test_constraint_and_score_search_recover_the_graph(spark):
    df, truth = synthetic_scm(spark, 6000, 4, edges=EDGES, seed=3)
    cols = [f"X{i}" for i in range(4)]
    want = {("X0", "X2"), ("X1", "X2"), ("X2", "X3")}
    assert {(r.src, r.dst) for r in truth.collect()} == want
    cp = constraint.pc(df, cols, "fisherz", 0.001).collect()
    assert {(r.src, r.dst) for r in cp if r.mark_dst == "arrow"} == want
    assert {(r.src, r.dst) for r in score.greedy_search(score.bic_scorer(df, cols), df.select(F.lit("all").alias("graph_id")).limit(1), cols).collect()} == want
    pag = constraint.fci(df, cols, "fisherz", 0.001).collect()
    assert {(r.src, r.dst) for r in pag if r.mark_dst == "arrow"} == want


def test_hidden_cause_gives_bidirected_edge(spark):
    df = spark.range(8000).select(F.randn(1).alias("h"), F.randn(2).alias("e1"), F.randn(3).alias("e2"), F.randn(4).alias("a"), F.randn(5).alias("b"))
    df = df.select("a", "b", (F.col("a") + F.col("h") + 0.5 * F.col("e1")).alias("x"), (F.col("b") + F.col("h") + 0.5 * F.col("e2")).alias("y"))
    pag = constraint.fci(df, ["a", "b", "x", "y"], "fisherz", 0.001).where("bidirected").collect()
    assert {frozenset((r.src, r.dst)) for r in pag} == {frozenset(("x", "y"))}


def test_count_tests_and_bdeu(spark):
    df = spark.range(6000).select(F.floor(F.rand(1) * 3).alias("a"), F.rand(2).alias("u"), F.rand(3).alias("v"))
    df = df.select("a", F.when(F.col("u") < 0.8, F.col("a")).otherwise(F.lit(0)).alias("b"), F.floor(F.col("v") * 2).alias("c"))
    for kind in ("chi2", "g2"):
        sk, _ = constraint.pc_skeleton(constraint.count_test(df, ["a", "b", "c"], None, kind), constraint.all_pairs(df, ["a", "b", "c"]), 0.001)
        assert {(r.x, r.y) for r in sk.collect()} == {("a", "b")}
    fams = spark.createDataFrame([("all", "b", []), ("all", "b", ["a"]), ("all", "b", ["c"])], "graph_id string, node string, parents array<string>")
    s = {tuple(r.parents): r.score for r in score.bdeu_scorer(df, ["a", "b", "c"])(fams).collect()}
    assert s[("a",)] > s[()] > s[("c",)]


def test_lingam_direction(spark):
    df, _ = synthetic_scm(spark, 8000, 4, edges=[(0, 1, 1.0), (1, 2, 1.0), (0, 3, -1.0)], uniform_noise=True, seed=5)
    out = {(r.src, r.dst): r.weight for r in lingam.direct_lingam(df, ["X3", "X2", "X1", "X0"], 0.1).collect()}
    assert set(out) == {("X0", "X1"), ("X1", "X2"), ("X0", "X3")} and out[("X0", "X3")] == pytest.approx(-1.0, abs=0.1)


@pytest.fixture(scope="module")
def lagged_series(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=(1500, 3))
    v = np.zeros((1500, 3))
    for t in range(1, 1500):
        v[t] = [0.3 * v[t - 1, 0] + e[t, 0], 0.6 * v[t - 1, 0] + e[t, 1], e[t, 2]]
    return spark.createDataFrame(pd.DataFrame(v, columns=["p", "q", "r"]).assign(t=range(1500)))


def test_temporal_discovery(lagged_series):
    cols = ["p", "q", "r"]
    g = temporal.granger_pairwise(lagged_series, cols, ["t"], 2, 1e-6).collect()
    assert {(x.src, x.dst) for x in g} == {("p", "q")}
    v = temporal.var_fit(lagged_series, cols, ["t"], 1, 0.2).first()
    assert (v.src, v.dst, v.time_lag) == ("p", "q", 1) and v.weight == pytest.approx(0.6, abs=0.08)
    lasso = temporal.granger_lasso(lagged_series, cols, ["t"], 1, 0.1).collect()
    assert {(x.src, x.dst) for x in lasso} == {("p", "q")}
    te = {(x.src, x.dst): x.te for x in temporal.transfer_entropy(lagged_series, cols, ["t"], 1, 5, all_lags=True).collect()}
    assert max(te, key=te.get) == ("p", "q")


def test_stationarity(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=800)
    df = spark.createDataFrame(pd.DataFrame({"t": range(800), "noise": e, "walk": e.cumsum()}))
    noise, walk = windows.stationarity_verdict(df, "noise", ["t"]).first(), windows.stationarity_verdict(df, "walk", ["t"]).first()
    assert noise.verdict == "Stationary" and walk.adf_p > 0.05 and walk.kpss_p <= 0.05


def test_anm_direction(spark):
    df = spark.range(4000).select((F.rand(1) * 4 - 2).alias("x"), (F.rand(2) - 0.5).alias("e")).withColumn("y", F.pow("x", F.lit(3)) + F.col("e"))
    assert pairwise.anm_direction(df, "x", "y").first().direction == "x->y"


def test_effects_recover_truth(spark):
    df = spark.range(20000).select("id", F.randn(1).alias("c"), F.randn(2).alias("e"), F.rand(3).alias("u"))
    df = df.withColumn("t", (F.col("u") < 1 / (1 + F.exp(-F.col("c")))).cast("int")).withColumn("y", 2 * F.col("t") + 3 * F.col("c") + F.col("e"))
    adj = effects.ate_backdoor(df, "t", "y", ["c"]).first()
    assert adj.effect == pytest.approx(2.0, abs=0.1) and adj.ci_low < 2.0 < adj.ci_high
    assert effects.ate_difference(df, "t", "y").first().effect > 3
    boot = effects.ate_bootstrap(df, "t", "y", ["c"], key=["id"], draws=200).first()
    assert boot.std_err == pytest.approx(adj.std_err, rel=0.25) and boot.ci_low < 2.0 < boot.ci_high
    again = effects.bootstrap_draws(df.repartition(7), "t", "y", ["c"], ["id"], 20).orderBy("draw").toPandas()
    first = effects.bootstrap_draws(df.coalesce(2), "t", "y", ["c"], ["id"], 20).orderBy("draw").toPandas()
    np.testing.assert_allclose(again["effect"], first["effect"], rtol=1e-8)


def test_counterfactual_chain_and_category(spark):
    df = spark.range(5000).withColumn("a", F.randn(1)).withColumn("b", 2 * F.col("a") + 0.1 * F.randn(2)).withColumn("y", F.col("b") + 1)
    r = effects.counterfactual(df, [("a", "b"), ("b", "y")], "a", 3.0, "y").first()
    assert r["mean"] == pytest.approx(7.0, abs=0.1) and r["size"] == "substantial"
    cat = df.withColumn("k", F.when(F.col("b") > 0, "hi").otherwise("lo"))
    models = effects.fit_structure(cat, [("b", "k")], ["k"])
    guess = cat.withColumn("g", effects._predict(models["k"], {"b": F.col("b")}))
    assert guess.where("g = k").count() > 4900


def test_vector_topk_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(80, 6)), rng.normal(size=(9, 6))
    chunks = spark.createDataFrame([(i, 0, [float(v) for v in r], {"k": str(i % 2)}) for i, r in enumerate(x)], "document_id long, chunk_id int, embedding array<float>, metadata map<string,string>").repartition(5)
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id long, embedding array<double>")
    for block in (100, 2):
        monkeypatch.setattr(vectors, "QUERIES", block)
        got = text.vector_topk(queries, chunks, 4, 0.0).toPandas()
        for i in range(9):
            d = ((x - q[i]) ** 2).sum(axis=1)
            assert list(got[got.query_id == i].sort_values("rank")["document_id"]) == list(np.argsort(d)[:4])
    odd = text.vector_topk(queries, chunks, 4, 0.0, {"k": "1"}).toPandas()
    assert (odd["document_id"] % 2 == 1).all() and len(odd) == 36


def test_recursive_chunks_cover_the_text(spark):
    words = [f"w{i}" for i in range(900)]
    body = "".join(w + ("\n\n" if i % 97 == 0 else "\n" if i % 13 == 0 else " ") for i, w in enumerate(words)) + "x" * 700
    got = text.chunk_recursive(spark.createDataFrame([(1, body), (2, "")], "id int, t string"), "t", ["id"], 300, 60).orderBy("chunk_id").collect()
    parts = [r.content for r in got]
    assert max(map(len, parts)) <= 300 and {r.id for r in got} == {1}
    seen, shared = [], 0
    for p in parts:
        mine = [w for w in p.split() if w.startswith("w")]
        shared += len(set(mine) & set(seen))
        seen += [w for w in mine if w not in seen]
    assert seen == words and shared > 0 and sum(p.count("x") for p in parts) >= 700


def test_json_orients(spark, tmp_path):
    rows = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", "z"]})
    for orient in ("records", "columns", "index", "split"):
        d = tmp_path / orient
        d.mkdir()
        (d / "t.json").write_text(rows.to_json(orient=orient))
        got = files.read_json_oriented(spark, str(d), orient, spark.createDataFrame(rows).schema).orderBy("a").toPandas()
        pd.testing.assert_frame_equal(got, rows)


def test_separators(spark, tmp_path):
    for sep in (";", "\t", "|", ",", " "):
        f = tmp_path / f"f{ord(sep)}.txt"
        f.write_text(sep.join("ab") + "\n" + "\n".join(f"{i}{sep}{i * 2}" for i in range(5)))
        got = files.read_delimited_text(spark, str(f))
        assert got.columns == ["a", "b"] and got.agg(F.sum("b")).first()[0] == 20


def test_jdbc_options():
    o = databases.connection_options("postgresql", "shop", "db", user="u")
    assert o == {"url": "jdbc:postgresql://db:5432/shop", "driver": "org.postgresql.Driver", "user": "u"}


def test_steps_stop_at_first_error(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "a int, b double")
    out, log = run_steps(df, [{"type": "dropna"}, {"type": "select_columns", "columns": ["nope"]}, {"type": "dropna"}])
    assert out.count() == 1 and [r.status for r in log.collect()] == ["ok", "error"]


def test_encodings_keep_missing(spark):
    df = spark.createDataFrame([("b d",), (None,), ("a'c",), ("b d",)], "c string")
    assert [r.c_label for r in scaling.encode_label(df, ["c"]).orderBy("c").collect()] == [None, 0, 1, 1]
    assert set(scaling.encode_onehot(df, ["c"]).columns) == {"c_a'c", "c_b d"}


def test_direction_answers_in_order(spark):
    e = _graphs(spark, [("a", "b"), ("a", "c")])
    a = spark.createDataFrame([("g", json.dumps({"first": "backward", "second": "bidirected"}))], "graph_id string, answer string")
    got = {(r.src, r.dst, r.bidirected) for r in answers.apply_directions(e, a).collect()}
    assert got == {("b", "a", False), ("a", "c", True), ("c", "a", True)}


def test_stream_equals_batch(spark, sf, tmp_path):
    from causalmill.streaming.resample import resample_stream, write_buckets

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    write_buckets(resample_stream(stream, "ts", "1 day", "mean", ["value"], ["event_type"]), out, tmp_path.name).awaitTermination()
    got = spark.read.parquet(out)
    want = resample_stream(events, "ts", "1 day", "mean", ["value"], ["event_type"])
    last = want.agg(F.max("bucket")).first()[0]
    a = got.orderBy("bucket", "event_type").toPandas()
    b = want.where(F.col("bucket") < F.lit(last)).orderBy("bucket", "event_type").toPandas()
    pd.testing.assert_frame_equal(a[a["bucket"] < last].reset_index(drop=True), b.reset_index(drop=True))
