"""Registered queries against their SQL twins on the smallest tables (``tools/check.py`` runs all of them)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, canon  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SOME = [
    "filter_conditions", "step_spec", "missing_profile", "scale_robust", "encode_label", "profile_var_types", "histogram", "corr_spearman", "cramers_v",
    "welch_t", "ks_two_sample", "rolling_features", "resample_periods", "graph_stats", "path_summary", "graph_diff", "ate_frontdoor", "relation_change",
    "transfer_entropy", "vector_topk", "apply_verdicts", "ensemble_vote",
]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted((tuple(canon(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    rows = sorted((tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and mine == rows


def test_workers_get_the_package(tmp_path):
    """A driver and workers that were started in another folder run a query that calls Python."""
    import subprocess

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {home!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["ate_backdoor"](spark, "/root/testdata/sf0.001").count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
