import pandas as pd
import pytest

from riskspark.operators import clean, stats
from riskspark.operators.quantiles import exact_quantiles


def _df(spark, vals, name="x"):
    return spark.createDataFrame([(v,) for v in vals], f"{name} double")


@pytest.mark.parametrize("vals", [[1.0, 2.0, 3.0, 4.0], [5.0], [7.0, 7.0, 7.0], [3.0, 1.0, 2.0, 10.0, 4.0, 4.0, 9.0]])
def test_quantiles_match_pandas(spark, vals):
    q = exact_quantiles(_df(spark, vals), "x", [0.25, 0.5, 0.75], moments=True).collect()[0]
    s = pd.Series(vals)
    assert q.q25 == pytest.approx(s.quantile(0.25))
    assert q.q50 == pytest.approx(s.median())
    assert q.q75 == pytest.approx(s.quantile(0.75))
    assert q.min == min(vals) and q.max == max(vals)
    if len(vals) == 1:
        assert q.sd is None
    else:
        assert q.sd == pytest.approx(s.std())


def test_quantiles_empty(spark):
    assert exact_quantiles(_df(spark, [None]), "x", [0.5]).count() == 0


def test_grouped_quantiles_partition_invariant(spark):
    rows = [("a" if i % 3 else "b", float((i * 37) % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for coarse, parts in ((4096, 1 << 20), (1, 4), (1, 1)):
        got = {r.g: r.q50 for r in exact_quantiles(df, "x", [0.5], group_cols=["g"], coarse=coarse, parts=parts).collect()}
        for g, sub in pdf.groupby("g"):
            assert got[g] == pytest.approx(sub.x.median())


def test_median_impute_interpolates(spark):
    df = _df(spark, [1.0, 2.0, 3.0, 4.0, None])
    out = [r.x for r in clean.median_impute(df, ["x"]).collect()]
    assert out[-1] == 2.5


def test_null_profile(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    p = {r.column: (r.n_null, r.has_values) for r in clean.null_profile(df, ["a", "b"]).collect()}
    assert p == {"a": (1, True), "b": (2, False)}


def test_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.5)], "a double, c double, b double")
    r = {(x.x, x.y): x.r for x in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert r[("a", "c")] is None
    assert r[("a", "b")] == pytest.approx(pd.Series([1, 2, 3]).corr(pd.Series([2, 4, 6.5])))


def test_trend_needs_two_points(spark):
    one = spark.createDataFrame([(1.0, 0.5)], "x double, y double")
    assert stats.trend_fit(one, "x", "y").count() == 0
    two = spark.createDataFrame([(1.0, 0.5), (3.0, 0.9)], "x double, y double")
    f = stats.trend_fit(two, "x", "y").collect()[0]
    assert f.slope == pytest.approx(0.2) and f.intercept == pytest.approx(0.3)
    line = stats.trend_line(two, "x", "y").orderBy("k").collect()
    assert len(line) == 100 and line[0].x == 1.0 and line[-1].x == 3.0


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "risk_band string, risk_percent double")
    b = stats.box_stats(df).collect()[0]
    assert b.q1 == 2.0 and b.q3 == 4.0 and b.upper_fence == 7.0
    assert b.whisker_hi == 4.0 and b.n_outliers == 1
    assert stats.outliers(df.withColumn("record_id", df.risk_percent.cast("long"))).count() == 1


def test_latest_tie_break(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0.1), (2, "2024-01-01 00:00:00", 0.7),
                                (0, "2023-12-31 00:00:00", 0.9)], "record_id long, t string, probability double") \
        .selectExpr("record_id", "cast(t as timestamp_ntz) as timestamp", "probability")
    r = stats.latest_score(df).collect()[0]
    assert r.record_id == 2 and r.risk_band == "High"


def test_corr_stable_with_large_offset(spark):
    xs = [1e9 + (i * 37 % 11) * 0.5 for i in range(200)]
    ys = [2.0 * (x - 1e9) + (i % 3) for i, x in enumerate(xs)]
    df = spark.createDataFrame(list(zip(xs, ys)), "a double, b double")
    r = {(x.x, x.y): x.r for x in stats.corr_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "b")] == pytest.approx(pd.Series(xs).corr(pd.Series(ys)), abs=1e-9)
    assert r[("a", "a")] == pytest.approx(1.0)


def test_summary_partition_invariant_on_table(spark):
    from riskspark.sources.tables import history_view
    from .conftest import SF
    h = stats.scored(history_view(spark, SF))
    s = h.select("risk_percent").toPandas().risk_percent
    for coarse, parts in ((4096, 1 << 20), (1, 4), (1, 1)):
        q = exact_quantiles(h, "risk_percent", [0.25, 0.5, 0.75], coarse=coarse, parts=parts).collect()[0]
        assert (q.q25, q.q50, q.q75) == pytest.approx((s.quantile(0.25), s.median(), s.quantile(0.75)))


def test_approx_quantiles_close_to_exact(spark):
    from riskspark.operators.quantiles import approx_quantiles
    vals = [float((i * 7919) % 1000) for i in range(5000)]
    df = _df(spark, vals)
    a = approx_quantiles(df, "x", [0.25, 0.5, 0.75]).collect()[0]
    s = pd.Series(vals)
    for got, p in ((a.q25, 0.25), (a.q50, 0.5), (a.q75, 0.75)):
        assert abs(got - s.quantile(p)) <= 2.0
