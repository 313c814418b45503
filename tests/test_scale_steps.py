"""Steps that must grow no faster than their input: plans without quadratic frames, the same results in the compact forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalmill.functions import ordered
from causalmill.operators import missing


def _plan(df):
    return df._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_backward_fill_is_a_running_frame(spark, monkeypatch, limit):
    """A frame to the end of the series is evaluated anew for every row; the fill runs over the reversed order instead."""
    monkeypatch.setattr(ordered, "SERIES_LIMIT", limit)
    df = spark.createDataFrame([(s, None if i == 7 else i, i * 1.0 if i % 5 == 3 else None) for s in "ab" for i in range(40)], "s string, i int, v double")
    out = ordered.carried(df, ["i"], {"f": F.col("v")}, {"b": F.col("v")}, ["s"])
    assert "unboundedfollowing" not in _plan(out)
    for s in "ab":
        rows = sorted(out.where(F.col("s") == s).collect(), key=lambda r: (r.i is not None, r.i or 0))
        known = [r.v for r in rows]
        assert [r.b for r in rows] == [next((v for v in known[j:] if v is not None), None) for j in range(40)]
        assert [r.f for r in rows] == [next((v for v in known[j::-1] if v is not None), None) for j in range(40)]


def test_suffix_min_is_a_running_frame(spark):
    df = spark.createDataFrame([(i, float((i * 7) % 11)) for i in range(50)], "i int, v double")
    out = ordered.with_suffix_min(df, ["i"], "v", "m")
    assert "unboundedfollowing" not in _plan(out)
    assert [r.m for r in out.orderBy("i").collect()] == [min(float((j * 7) % 11) for j in range(i, 50)) for i in range(50)]


def test_ks_marks_change_nothing(spark, monkeypatch):
    """Every row is sorted once whatever the number of pairs; the distances of 7 periods are those by hand, with nulls, -0.0, NaN and small periods."""
    import numpy as np

    from causalmill.operators.discovery import shift

    monkeypatch.setattr(shift, "GRID", 5)
    monkeypatch.setattr(shift, "TOGETHER", 3)
    rng = np.random.default_rng(3)
    rows = [(f"p{k % 7}" if k % 31 else None, float(v), float("nan") if k % 17 == 0 else None if k % 13 == 0 else float(np.floor(v * (1 + k % 7))) * -0.0 if k % 11 == 0 else float(k % 4), None)
            for k, v in enumerate(rng.normal(size=700))] + [("p9", 1.0, 2.0, None)] * 4
    df = spark.createDataFrame(rows, "period string, a double, b double, e double")
    got = {(r.column, r.p1, r.p2): (r.n1, r.n2, r.d) for r in shift.detail_ks(df, ["a", "b", "e"], "period").collect()}
    want = {}
    for c, at in (("a", 1), ("b", 2)):
        parts = {p: np.sort([float("inf") if np.isnan(r[at]) else r[at] for r in rows if r[0] == p and r[at] is not None]) for p in sorted({r[0] for r in rows if r[0]}) if p != "p9"}
        for p in parts:
            for q in parts:
                if p < q:
                    v = np.concatenate([parts[p], parts[q]])
                    d = np.abs(np.searchsorted(parts[p], v, "right") / len(parts[p]) - np.searchsorted(parts[q], v, "right") / len(parts[q])).max()
                    want[(c, p, q)] = (len(parts[p]), len(parts[q]), d)
    assert got == want


def test_groups_reach_without_written_edges(spark):
    """Edges between all pairs of a group are read off its members; both directions and several seeds give what the pairs give."""
    import random

    from causalmill.operators import graph

    rng = random.Random(5)
    rows = [(g, f"c{rng.randrange(25)}", f"p{rng.randrange(40)}") for g in "ab" for _ in range(70)] + [("a", None, "p1"), ("a", "c1", None), (None, "c1", "p1")]
    members = spark.createDataFrame(rows, "graph_id string, `group` string, node string")
    one, two = members.withColumnRenamed("node", "src"), members.withColumnRenamed("node", "dst")
    pairs = one.join(two, ["graph_id", "group"]).where("src < dst").select("graph_id", "src", "dst").distinct()
    seeds = spark.createDataFrame([("a", "p2"), ("a", "p30"), ("b", "p1")], "graph_id string, node string")
    got = sorted(map(tuple, graph.ancestors_descendants(members, seeds).collect()))
    assert len(got) > 20 and got == sorted(map(tuple, graph.ancestors_descendants(pairs, seeds).collect()))


def test_groups_are_packed_once_for_all_rounds(spark, monkeypatch):
    """The members are shuffled by node and by group and then only read as packs; a long chain, repeated rows, lone members and several seeds."""
    import random

    from pyspark.sql import functions as F

    from causalmill.operators import graph
    from causalmill.operators.groups import index_groups

    rng = random.Random(7)
    rows = [("a", f"c{i:03d}", f"p{j:03d}") for i in range(60) for j in (i, i + 1)] + [(g, f"g{rng.randrange(90)}", f"q{rng.randrange(200)}") for g in "ab" for _ in range(300)]
    rows += [*rows[::5], ("a", "x", "p000a"), ("c", "x", "p1"), ("a", None, "p1"), ("a", "c1", None), (None, "c1", "p1")]
    members = spark.createDataFrame(rows, "graph_id string, `group` string, node string")
    monkeypatch.setattr(graph, "reach_in_groups", None)
    index = index_groups(members)
    assert index.packs.count() <= index.packs.rdd.getNumPartitions() * 2 and index.size == len({(g, n) for g, k, n in rows if None not in (g, k, n)})
    pairs = sorted({(g, x, y) for g, k, x in rows for h, l, y in rows if None not in (g, k, x, y) and (g, k) == (h, l) and x < y})
    assert {(r.graph_id, r.node) for r in index.lowest().collect()} == {("a", min(x for g, x, _ in pairs if g == "a")), ("b", min(x for g, x, _ in pairs if g == "b"))}

    def reached(begin, forward):
        front, seen = [begin], set()
        while front:
            g, n = front.pop()
            new = {(h, y if forward else x) for h, x, y in pairs if h == g and (x if forward else y) == n} - seen
            seen |= new
            front += new
        return seen

    seeds = [("a", "p000"), ("a", "p030"), ("a", "q50"), ("b", "q17"), ("a", "p000a"), ("a", "none")]
    want = sorted({(g, n, m) for g, n in seeds for _, m in reached((g, n), True)} | {(g, m, n) for g, n in seeds for _, m in reached((g, n), False)})
    given = spark.createDataFrame(seeds, "graph_id string, node string")
    assert len(want) > 150 and sorted(map(tuple, graph.ancestors_descendants(members, given).collect())) == want
    assert sorted(map(tuple, graph.ancestors_descendants(index, given).collect())) == want
    none = index_groups(members.where(F.lit(False)))
    assert none.size == 0 and graph.ancestors_descendants(none, none.lowest()).isEmpty()


def test_packs_hold_whole_groups(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from causalmill.operators import groups

    monkeypatch.setattr(groups, "PACK", 7)
    sizes = [3, 1, 20, 2, 2, 2, 1, 5, 1]
    rows = [("a" if i < 5 else "b", f"g{i}", 10 * i + j) for i, n in enumerate(sizes) for j in range(n)]
    rows.insert(1, rows[0])  # given twice
    for cut in (1, 4, 9, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("graph_id", "group", "n"), r, strict=True)) for r in rows[i : i + cut]]) for i in range(0, len(rows), cut)]
        got, low = [], {}
        for b in groups._pack(iter(batches), np.int32):
            r = b.to_pylist()[0]
            ids, at = np.frombuffer(r["ids"], np.int32).tolist(), 0
            for n in np.frombuffer(r["sizes"], np.int64):
                got.append(ids[at : at + n])
                at += n
            assert at == len(ids)
            for g, n in zip(r["graphs"], r["lows"], strict=True):
                low[g] = min(n, low.get(g, n))
        assert got == [[10 * i + j for j in range(n)] for i, n in enumerate(sizes) if n > 1] and low == {"a": 0, "b": 50}


def _no_uncompressed_copy(monkeypatch, graph):
    def refuse(df):
        raise AssertionError("a table of the size of the edges is stored uncompressed")

    monkeypatch.setattr(graph, "cut_lineage", refuse)


def test_shared_neighbours_off_cycles(spark, monkeypatch):
    """All common neighbours of every pair, with hubs, loops, repeated and null ends; no wedge is stored."""
    import itertools
    import random

    from causalmill.operators import graph

    _no_uncompressed_copy(monkeypatch, graph)
    rng = random.Random(9)
    rows = [(g, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for g in "ab" for _ in range(80)] + [("a", "hub", f"n{i}") for i in range(30)] + [("a", None, "n1"), (None, "n1", "n2")]
    got = {(r.graph_id, r.a, r.b): (r.common, r.shared) for r in graph.shared_neighbours(spark.createDataFrame(rows, "graph_id string, src string, dst string")).collect()}
    near = {}
    for g, s, d in rows:
        if g and s and d and s != d:
            near.setdefault((g, s), set()).add(d)
            near.setdefault((g, d), set()).add(s)
    want = {}
    for (g, a), (h, b) in itertools.product(near, near):
        both = near[(g, a)] & near[(h, b)]
        if g == h and a < b and len(both) >= 2:
            want[(g, a, b)] = (len(both), sorted(both))
    assert got == want


def test_weak_components_store_compact_rounds(spark, monkeypatch):
    from causalmill.operators import graph

    _no_uncompressed_copy(monkeypatch, graph)
    edges = [("a", f"n{i:02d}", f"n{i + 1:02d}") for i in range(20) if i != 9] + [("b", "x", "x"), ("b", "y", "x")]
    got = {(r.graph_id, r.node): r.component for r in graph.weak_components(spark.createDataFrame(edges, "graph_id string, src string, dst string")).collect()}
    assert got == {**{("a", f"n{i:02d}"): "n00" if i < 10 else "n10" for i in range(21)}, ("b", "x"): "x", ("b", "y"): "x"}


def test_small_files_listed_in_few_tasks_and_batches(spark, tmp_path):
    from causalmill.operators import text

    for i in range(1_001):
        (tmp_path / "in" / f"d{i % 50}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 50}" / f"{i}.txt").write_text(f"a{i}\n\nb")
    before = spark.conf.get(text.LISTING)
    with text.listing_tasks(spark):
        assert int(spark.conf.get(text.LISTING)) == 4 * spark.sparkContext.defaultParallelism
    folder, store, progress = (str(tmp_path / d) for d in ("in", "store", "progress"))
    out = text.ingest_stream(spark, folder, store, progress, "1")
    assert out.count() == 2_002 and out.select("document_id").distinct().count() == 1_001 and spark.conf.get(text.LISTING) == before
    assert [p.name for p in (tmp_path / "progress" / "commits").iterdir() if not p.name.startswith(".")] == ["0"]  # one batch
    assert text.ingest_stream(spark, folder, store, progress, "2").where("run = '2'").isEmpty()


def test_documents_written_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """A file per document, in few folders and without one of Spark's checksum files each; repeated and null keys share a file; a batch takes four tasks per core."""
    import hashlib

    from causalmill.operators import text
    from causalmill.plans.queries import q07_text

    monkeypatch.setattr(q07_text, "scratch", lambda spark, name: f"file:{tmp_path / 'a b' / name}")
    docs = [(i, f" t{i} \n\nü{i}", "en" if i % 3 else "fr") for i in range(2_000)] + [(7, "again", "en"), (8, None, "en"), (9_000, "", None), (9_001, None, "de"), (None, "lost", "en"), (None, "lost", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = q07_text.ingest_new(spark, str(tmp_path))
    want = {}
    for k, t, lang in docs:
        run, name = "first" if lang == "en" else "second", "__HIVE_DEFAULT_PARTITION__" if k is None else str(k)
        want.setdefault((name, run), []).append(t or "")
    got = {}
    for r in out.collect():
        got.setdefault((r.document_id, r.run), {})[r.chunk_id] = r.content
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got.keys() == want.keys() and len(got) == 2_003
    for k, texts in want.items():
        if len(texts) == 1 or k[0].startswith("__"):  # the order of rows in a file is free
            lines = [(i, p.strip()) for i, p in enumerate("\n".join(texts).split("\n")) if p.strip()]
            assert got[k] == {i: md5(p) for i, p in lines or [(0, text.EMPTY)]}
    assert sorted(got["7", "first"].values()) == sorted(map(md5, ["t7", "ü7", "again"])) and sorted(got["8", "first"].values()) == sorted(map(md5, ["t8", "ü8"]))
    written = [p for p in (tmp_path / "a b" / "corpus").rglob("*") if p.is_file()]
    assert len(written) == 2_003 and len({p.parent for p in written}) <= 2 * 4 + 2_003 // text.FILES_PER_FOLDER
    parts = [p for p in (tmp_path / "a b" / "chunks").glob("part-*")]
    assert len(parts) <= 2 * (4 * spark.sparkContext.defaultParallelism + 1)


def test_packed_and_empty_files_are_ingested_as_before(spark, tmp_path):
    import gzip

    from causalmill.operators import text

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(b"one\n\ntwo"))
    (tmp_path / "in" / "b.txt").write_bytes(b"")
    (tmp_path / "in" / "c.txt").write_bytes(b"\n")
    (tmp_path / "in" / "d.txt").write_bytes(b"\xff three")
    read = lambda n, patterns: [(r.document_id, r.content) for r in text.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / f"s{n}"), str(tmp_path / f"p{n}"), "1", patterns).orderBy("document_id", "chunk_id").collect()]
    plain = read(1, "*.txt")
    assert [plain[0], plain[1][0]] == [("c.txt", text.EMPTY), "d.txt"] and len(plain) == 2 and plain[1][1].endswith(" three")
    assert read(2, "*.{gz,txt}") == [("a.gz", "one"), ("a.gz", "two"), *plain]


def test_weak_components_list_lone_nodes_only(spark, monkeypatch):
    from causalmill.operators import graph

    listed, plain = [], graph.nodes_of
    monkeypatch.setattr(graph, "nodes_of", lambda edges: listed.extend(edges.collect()) or plain(edges))
    edges = [("a", "n2", "n1"), ("a", "n1", "n2"), ("a", "n3", "n2"), ("a", "n3", "n3"), ("a", "n9", "n9"), ("a", None, "n8"), (None, "n1", "n2"), ("b", "n2", "n4"), ("b", "n2", "n4")]
    given = spark.createDataFrame(edges, "graph_id string, src string, dst string")
    nodes = spark.createDataFrame([("a", "n1"), ("c", "n7"), ("c", "n7")], "graph_id string, node string")
    lone = [("a", "n8", "n8"), ("a", "n9", "n9"), ("a", None, None), (None, "n1", "n1"), (None, "n2", "n2")]
    tied = [("a", "n1", "n1"), ("a", "n2", "n1"), ("a", "n3", "n1"), ("b", "n2", "n2"), ("b", "n4", "n2")]
    for extra, more in ((None, []), (nodes, [("c", "n7", "n7")])):
        got = [tuple(r) for r in graph.weak_components(given, extra).select("graph_id", "node", "component").collect()]
        assert sorted(got, key=str) == sorted(lone + tied + more, key=str)
    assert listed and all(None in tuple(r) or r.src == r.dst for r in listed)


def test_regression_fill_makes_no_vectors_for_known_rows(spark):
    """A line over numbers is a plain expression; the vectors of a forest are made only where the class is missing."""
    rows = [(i, float(i % 17) if i % 13 else None, i * 1.5 if i % 5 else None, "ab"[i % 17 > 8] if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string")
    line = missing.impute_regression(df, "y", ["x", "id"])
    assert "udf(" not in _plan(line)
    mean = np.mean([r[1] for r in rows if r[1] is not None])
    design = np.array([[1.0, mean if r[1] is None else r[1], r[0]] for r in rows])
    known = np.array([r[2] is not None for r in rows])
    coef = np.linalg.lstsq(design[known], np.array([r[2] for r in rows if r[2] is not None]), rcond=None)[0]
    for r, want in zip(line.orderBy("id").collect(), design @ coef):
        assert r.y == pytest.approx(rows[r.id][2] if rows[r.id][2] is not None else want)
    filled = missing.impute_regression(line, "c", ["x"])
    optimized = filled._jdf.queryExecution().optimizedPlan().toString()
    assert "_features" not in optimized and "UDF(" in optimized  # vectors and votes stand inside the coalesce of the class
    for r in filled.collect():
        assert r.c == (rows[r.id][3] or ("ab"[r.id % 17 > 8] if r.x is not None else r.c))


def test_regression_fill_keeps_columns_that_hang_together(spark):
    df = spark.createDataFrame([(i, 1.0 * i, 2.0 * i, 1.0, None if i == 9 else 3.0 * i + 1) for i in range(20)], "id int, a double, b double, one double, y double")
    assert missing._line(df.where("y IS NOT NULL"), "y", ["a", "b"]) is None and missing._line(df.where("y IS NOT NULL"), "y", ["a", "one"]) is None
    for predictors in (["a", "b"], ["a", "one"]):
        assert missing.impute_regression(df, "y", predictors).where("id = 9").first().y == pytest.approx(28.0)
