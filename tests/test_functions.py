"""Shared functions against pandas, numpy and the JVM's distributions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalmill.functions import moments, ordered, pvalues, quantiles
from causalmill.operators import windows


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(600), "s": rng.choice(["a", "b", "c"], 600, p=[0.8, 0.15, 0.05]), "v": rng.normal(size=600).round(1)})
    pdf["h"] = pdf["v"].where(rng.random(600) > 0.6)
    return pdf.sample(frac=1, random_state=1).reset_index(drop=True)


def _spark(spark, pdf):
    out = spark.createDataFrame(pdf)
    return out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def test_sliced_series_equal_plain_windows(spark, series, monkeypatch):
    df = _spark(spark, series)
    key = ["id", "s"]

    def run():
        lag = windows.lag_features(df, ["v"], [1, 4], ["id"], ["s"], block_rows=7)
        roll = windows.rolling_features(lag, ["v"], [5], ["mean", "median"], ["id"], ["s"], block_rows=6)
        fill = ordered.carried(roll, ["id"], {"f": F.col("h")}, {"b": F.col("h")}, ["s"])
        return ordered.with_position(fill, ["id"], ["s"], length="len").toPandas().sort_values(key).reset_index(drop=True)

    plain = run()
    monkeypatch.setattr(ordered, "SERIES_LIMIT", 0)
    sliced = run()
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])
    ref = series.sort_values("id")
    g = ref.groupby("s")
    ref = ref.assign(v_lag4=g["v"].shift(4), f=g["h"].ffill(), b=g["h"].bfill(), pos=g.cumcount(), r=g["v"].transform(lambda x: x.rolling(5).mean()))
    ref = ref.sort_values(key)
    for mine, theirs in (("v_lag4", "v_lag4"), ("f", "f"), ("b", "b"), ("_pos", "pos"), ("v_roll5_mean", "r")):
        np.testing.assert_allclose(sliced[mine].astype(float), ref[theirs].astype(float), atol=1e-9)


def test_running_sums_and_suffix_min(spark, series):
    df = _spark(spark, series)
    out = ordered.with_running_sums(df, ["id"], {"c": F.col("v")}, ["s"]).toPandas().sort_values("id")
    ref = series.sort_values("id")
    np.testing.assert_allclose(out["c"], ref.groupby("s")["v"].cumsum(), atol=1e-9)
    np.testing.assert_allclose(out["c_total"], ref.groupby("s")["v"].transform("sum"), atol=1e-9)
    low = ordered.with_suffix_min(df, ["id"], "v", "m").toPandas().sort_values("id")
    np.testing.assert_allclose(low["m"], ref["v"][::-1].cummin()[::-1])


@pytest.mark.parametrize("narrow", [1_000_000, 0])
def test_quantiles_both_routes(spark, series, narrow, monkeypatch):
    monkeypatch.setattr(quantiles, "_NARROW", narrow)
    df = _spark(spark, series)
    qs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = quantiles.collect_quantiles(df, ["v", "h"], qs)
    np.testing.assert_allclose(got["v"], series["v"].quantile(qs))
    np.testing.assert_allclose(got["h"], series["h"].quantile(qs))
    by = quantiles.exact_quantiles(df, ["v"], [0.3], ["s"]).toPandas().set_index("s")["q0"]
    pd.testing.assert_series_equal(by.sort_index(), series.groupby("s")["v"].quantile(0.3), check_names=False)


def test_quantiles_of_empty_and_constant(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "a double, b double")
    assert quantiles.collect_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [2.0]}


def test_moments_wide_and_narrow_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, size=(300, 10))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(10)]).assign(g=["u", "v", "v"] * 100))
    cols = [f"c{i}" for i in range(10)]
    row = moments.moment_rows(df, cols).first()
    np.testing.assert_allclose(np.array(row["cov"]).reshape(10, 10), np.cov(x.T, bias=True), atol=1e-9)
    np.testing.assert_allclose(row["means"], x.mean(axis=0))
    a = {r.g: r["cov"] for r in moments.moment_rows(df, cols, ["g"]).collect()}
    b = {r.g: r["cov"] for r in moments.moment_rows(df, cols[:4], ["g"]).collect()}
    for g in ("u", "v"):
        np.testing.assert_allclose(np.array(a[g]).reshape(10, 10)[:4, :4].ravel(), b[g], atol=1e-9)


def test_tails_match_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.3, 4.0), (2.5, 17.0), (8.0, 900.0)):
        assert pvalues.t_two_sided(t, df) == pytest.approx(2 * (1 - d.TDistribution(df).cumulativeProbability(t)), abs=1e-10)
        assert pvalues.t_quantile(0.975, df) == pytest.approx(d.TDistribution(df).inverseCumulativeProbability(0.975), rel=1e-6)
    for f, a, b in ((0.7, 2.0, 9.0), (5.5, 3.0, 400.0)):
        assert pvalues.f_upper(f, a, b) == pytest.approx(1 - d.FDistribution(a, b).cumulativeProbability(f), abs=1e-10)
    for x, k in ((0.5, 1.0), (40.0, 22.0)):
        assert pvalues.chi2_upper(x, k) == pytest.approx(1 - d.ChiSquaredDistribution(k).cumulativeProbability(x), abs=1e-10)
