"""Cases that earlier versions answered wrongly: empty bins, large offsets, other labels, ties, NaN, NULL groups."""

import math

from riskspark.operators import evaluate, history, ml, ordered, quantiles, stats
from riskspark.schemas import FEATURE_KEYS


def test_histogram_reports_empty_bins_as_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (95.0,)], "risk_percent double")
    n = [r["n"] for r in stats.histogram(df).collect()]
    assert None not in n and sum(n) == 3 and n.count(0) == len(n) - 2


def test_sd_of_values_with_a_large_offset(spark):
    vals = [1e9 + (i % 3) for i in range(30)]
    df = spark.createDataFrame([(None if i % 2 else "g", v) for i, v in enumerate(vals)], "g string, v double")
    one = quantiles.exact_quantiles(df, "v", [0.5], moments=True).collect()[0]
    mean = sum(vals) / 30
    want = math.sqrt(sum((v - mean) ** 2 for v in vals) / 29)
    assert abs(one["sd"] - want) < 1e-6
    assert {r["g"] for r in quantiles.exact_quantiles(df, "v", [0.5], group_cols=["g"], moments=True).collect()} == {None, "g"}


def test_confusion_keeps_other_labels(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "label int, prediction int")
    got = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(df).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1, (2, 1): 1}


def test_best_model_without_position_takes_the_smallest_name(spark):
    df = spark.createDataFrame([("bb", 0.9), ("aaa", 0.9), ("c", 0.1)], "model string, accuracy double")
    assert evaluate.best_model(df, position_col=None).first()["model"] == "aaa"


def test_trend_ignores_nan_and_empty_history_has_no_band(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("nan"), 1.0)], "x double, y double")
    assert abs(stats.trend_fit(df, "x", "y").first()["slope"] - 2.0) < 1e-12
    empty = spark.createDataFrame([], "probability double")
    assert stats.risk_kpis(empty).first()["avg_band"] is None


def test_grouped_prefix_with_negative_values_and_null_group(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, -10), ("b", 1, -5), (None, 1, 7)], "g string, k int, v int")
    got = {(r["g"], r["k"]): r["_gcum_v"] for r in ordered.grouped_prefix(df, ["g"], ["k"], ["v"], n_buckets=2).collect()}
    assert got == {("a", 1): 5, ("a", 2): -5, ("b", 1): -5, (None, 1): 7}


def test_nested_null_wins_over_the_top_level(spark):
    df = spark.createDataFrame([(50.0, (None,))], "age double, input_data struct<age: double>")
    assert history.flatten_nested(df, keys=FEATURE_KEYS[:1]).first()["age"] is None


def test_saved_pipeline_scores_raw_rows_as_trained(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    rows = [(i, 100.0 + i if i % 17 else None, 1000.0 - 3 * i, int(i > 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    res, models, _ = ml.train_and_compare(df, ["a", "b"], estimators={"lr": LogisticRegression(labelCol="label", maxIter=50)},
                                          key_cols=["id"])
    models["lr"].write().overwrite().save(str(tmp_path / "m"))
    again = ml.score(PipelineModel.load(str(tmp_path / "m")), df)
    test = ml.deterministic_split(again, key_cols=["id"]).where("split = 'test'")
    acc = test.selectExpr("avg(cast(prediction = label as double)) a").first()["a"]
    assert abs(acc - res.first()["accuracy"]) < 1e-12 and acc > 0.9
    assert again.where("isnan(probability) or probability is null").count() == 0


def test_stream_reads_a_directory_table(spark, tmp_path):
    from riskspark.streaming.jobs import stream_daily_kpis
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    one = sorted(map(str, stream_daily_kpis(spark, "/root/testdata/sf0.001", glob="events.parquet").collect()))
    many = sorted(map(str, stream_daily_kpis(spark, str(tmp_path), glob="events.parquet").collect()))
    assert len(one) == len(many) > 0


def test_malformed_history_goes_to_quarantine(spark, tmp_path):
    from pyspark.sql import types as T
    from riskspark.sources import files
    (tmp_path / "h.json").write_text('{"record_id": 1, "probability": 0.5}\n{"record_id": 2, "prob\n\n{"record_id": 3}\n')
    schema = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("probability", T.DoubleType())])
    good = sorted(map(tuple, files.read_history_json(spark, str(tmp_path / "h.json"), schema).collect()))
    assert good == [(1, 0.5), (3, None)]
    bad = files.malformed_history_json(spark, str(tmp_path / "h.json"), schema)
    assert [r["raw"] for r in bad.collect()] == ['{"record_id": 2, "prob']
    (tmp_path / "a.json").write_text('[{"record_id": 4, "probability": 0.25},\n {"record_id": 5}]')
    many = files.read_history_json(spark, str(tmp_path / "a.json"), schema, multi_line=True)
    assert sorted(r["record_id"] for r in many.collect()) == [4, 5]
    assert files.malformed_history_json(spark, str(tmp_path / "a.json"), schema, multi_line=True).count() == 0


def test_bad_requests_are_rejected_before_scoring(spark):
    from riskspark.operators import validate
    df = spark.createDataFrame([(1, "1.5", 2.0), (2, "x", 2.0), (3, None, None), (4, "2", float("nan"))], "id int, a string, b double")
    good, bad = validate.split_requests(df, ["a", "b"])
    assert [tuple(r) for r in good.collect()] == [(1, 1.5, 2.0)]
    assert {r["id"]: r["bad_features"] for r in bad.collect()} == {2: ["a"], 3: ["a", "b"], 4: ["b"]}


def test_time_text_does_not_depend_on_the_session_zone(spark):
    from riskspark.functions import text
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00' AS t UNION ALL SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.5'")
        got = sorted(map(tuple, df.select(text.iso_text("t"), text.display_time("t")).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [("2024-03-10T02:30:00", "Mar 10 2024, 02:30"), ("2024-03-10T02:30:00.500000", "Mar 10 2024, 02:30")]
