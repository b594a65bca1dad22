import math

from pyspark.sql import functions as F

from riskspark.functions import (confidence, display_time, guidance, iso_text, key_to_display, parse_iso,
                                 risk_band, risk_band_percent)
from riskspark.operators import stats


def test_band_boundaries(spark):
    vals = [0.0, 0.29999999999999993, 0.3, 0.5999999999999999, 0.6, 1.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(risk_band("p")).collect()]
    assert got == ["Low", "Low", "Moderate", "Moderate", "High", "High", "High", "High"]


def test_percent_band_and_confidence(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (60.0,), (75.0,)], "x double")
    rows = df.select(risk_band_percent("x").alias("b"), confidence("x").alias("c"),
                     guidance(risk_band_percent("x")).alias("g")).collect()
    assert [r.b for r in rows] == ["Low", "Moderate", "High", "High"]
    assert [r.c for r in rows] == [70.1, 70.0, 60.0, 75.0]
    assert rows[0].g.startswith("Cardiovascular risk appears low")


def test_strict_over_60_kpi(spark):
    df = spark.createDataFrame([(0.6,), (0.6000001,), (0.1,)], "probability double")
    r = stats.risk_kpis(df).collect()[0]
    assert (r.high_n, r.over_60_n, r.low_n) == (2, 1, 1)


def test_iso_roundtrip_and_display(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02 03:04:05.120000",)], "s string") \
        .select(F.col("s").cast("timestamp_ntz").alias("ts"))
    rows = df.select(iso_text("ts").alias("iso"), display_time("ts").alias("d"),
                     (parse_iso(iso_text("ts")) == F.col("ts")).alias("ok")).collect()
    assert rows[0].iso == "2024-01-02T03:04:05"
    assert rows[1].iso == "2024-01-02T03:04:05.120000"
    assert rows[0].d == "Jan 02 2024, 03:04"
    assert all(r.ok for r in rows)


def test_key_display(spark):
    df = spark.createDataFrame([("random_forest",), ("logistic_regression",)], "k string")
    assert [r[0] for r in df.select(key_to_display("k")).collect()] == ["Random Forest", "Logistic Regression"]


def test_histogram_edges(spark):
    edges = stats.hist_edges()
    vals = [-1.0, 0.0, 100.0, 100.0001] + edges[1:-1]
    df = spark.createDataFrame([(v,) for v in vals], "risk_percent double")
    h = {r.bin: r.n for r in stats.histogram(df).collect()}
    assert len(h) == 11
    # 0 -> bin 1; every interior edge k -> bin k + 1; 100 -> bin 11 (closed); -1, 100.0001 dropped
    assert h[1] == 1 and h[11] == 2 and sum(h.values()) == 12
    assert all(h[k] >= 1 for k in range(2, 11))
    assert math.isclose(stats.histogram(df).where("bin = 6").collect()[0].center, 50.0)
