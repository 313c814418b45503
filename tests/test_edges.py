"""Constant columns, NaN, single groups, null patterns: defined results, the same on every route."""

import math

from pyspark.sql import functions as F

from causalmill.operators import association, missing, profile, windows


def test_constant_and_nan_columns(spark):
    rows = [(float(i % 2), 5.0, float(i), float("nan") if i == 3 else float(i * i), *[float((i * k) % 7) for k in range(1, 5)]) for i in range(40)]
    names = ["g", "same", "x", "y", "a", "b", "c", "d"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    cols = names[1:]
    wide = {(r.x, r.y): r for r in association.pair_stats(df, cols, ["g"]).where("g = 1").collect()}
    for x, y in (("same", "x"), ("x", "y")):
        r = association.pair_stats(df, [x, y], ["g"]).where("g = 1").first()
        w = wide[x, y]
        assert r.n == w.n and (r.r is None) == (w.r is None) and (r.r is None or math.isclose(r.r, w.r, rel_tol=1e-9))
    assert wide["same", "x"].r is None and wide["x", "y"].n == 19
    p = association.partial_corr(df, "same", "x", ["a"]).first()
    assert p.r is None and p.t is None and p.p_value is None and p.confirmed is None
    assert association.correlation_test(df, "same", "x", True).first().r is None
    assert profile.profile_normality(df, ["same"]).first().distribution == "unknown"


def test_one_group_and_empty_sample(spark):
    df = spark.createDataFrame([("a", float(i), True) for i in range(9)], "k string, v double, f boolean")
    assert association.anova_oneway(df, "v", "k")[0].first().f is None
    assert association.ks_two_sample(df, "v", "f").first().n2 == 0


def test_knn_null_patterns(spark):
    rows = [(0, None, 5.0, None), (1, None, None, 5.0)] + [(2 + i, float(100 * i), float(i), float(9 - i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    both = {r.id: r.a for r in missing.impute_knn(df, ["a", "b", "c"], "id", 3).collect()}
    alone = [missing.impute_knn(df.where(F.col("id") != 1 - i), ["a", "b", "c"], "id", 3).where(F.col("id") == i).first().a for i in (0, 1)]
    assert [both[0], both[1]] == alone == [500.0, 400.0]


def test_adf_lag_is_per_series(spark):
    long = [("long", i, math.sin(i) + (i * 37 % 11) / 10) for i in range(120)]
    short = [("short", i, float(i * 7 % 5)) for i in range(8)]
    schema = "s string, t int, v double"
    one = windows.stationarity_adf(spark.createDataFrame(long, schema), "v", ["t"], ["s"]).first()
    two = windows.stationarity_adf(spark.createDataFrame(long + short, schema), "v", ["t"], ["s"]).where("s = 'long'").first()
    assert one.lags == two.lags and math.isclose(one.statistic, two.statistic, rel_tol=1e-9)
