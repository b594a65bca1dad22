import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import ordered
from riskspark.sources.tables import history_view

from .conftest import SF


def test_rolling_mean_matches_pandas_and_is_partition_invariant(spark):
    h = history_view(spark, SF).withColumn("v", F.when(F.col("record_id") % 7 == 0, None)
                                           .otherwise(F.col("probability") * 100))
    pdf = h.toPandas().sort_values(["timestamp", "record_id"]).reset_index(drop=True)
    w = max(1, len(pdf) // 5)
    want = pdf.v.rolling(window=w, min_periods=1).mean().values
    for nb in (1, 3, 16):
        got = ordered.rolling_mean(h.select("record_id", "timestamp", "v"), "v", ["timestamp", "record_id"],
                                   n_buckets=nb).toPandas().sort_values("row_index")
        assert list(got.record_id) == list(pdf.record_id)
        assert got.rolling_mean.values == pytest.approx(want, abs=1e-9, nan_ok=True)


def test_small_history_window_one(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "id long, v double")
    got = ordered.rolling_mean(df, "v", ["id"]).orderBy("row_index").collect()
    assert [r.rolling_mean for r in got] == [10.0, 20.0, 30.0]  # n < 5 -> window 1


def test_hot_key_is_split_across_buckets(spark):
    # A third of the rows share one timestamp: the composite key still spreads them.
    rows = [(i, 0 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t long")
    b = ordered.pinned_order(df, ["t", "id"], n_buckets=16)
    sizes = [r[1] for r in b.groupBy("_bucket").count().collect()]
    assert max(sizes) < 1000 / 2
    idx = ordered.global_row_index(df, ["t", "id"], n_buckets=16).toPandas()
    want = pd.DataFrame(rows, columns=["id", "t"]).sort_values(["t", "id"]).id.tolist()
    assert idx.sort_values("row_index").id.tolist() == want


def test_no_single_partition_exchange(spark):
    h = history_view(spark, SF).select("record_id", "timestamp", "probability")
    plan = ordered.global_prefix(h, ["timestamp", "record_id"], ["probability"], n_buckets=4) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_null_order_keys_sort_last_and_spread(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t double")
    b = ordered.pinned_order(df, ["t", "id"], n_buckets=16)
    sizes = [r[1] for r in b.groupBy("_bucket").count().collect()]
    assert max(sizes) < 1000 / 2  # the 1,000 NULL-key rows are split too
    idx = ordered.global_row_index(df, ["t", "id"], n_buckets=16).toPandas().sort_values("row_index")
    want = pd.DataFrame(rows, columns=["id", "t"]).sort_values(["t", "id"], na_position="last").id.tolist()
    assert idx.id.tolist() == want
