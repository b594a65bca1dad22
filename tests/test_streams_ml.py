import uuid

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskspark.operators import ml
from riskspark.session import shared_dir
from riskspark.sources.artifacts import artifact_manifest, load_model, save_model
from riskspark.sources.tables import history_view
from riskspark.streaming import jobs

from .conftest import SF


def _separable(spark, n=200):
    rows = [(float(i % 50), float((i * 7) % 13), 1 if i % 50 >= 25 else 0) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, label int")


def test_trend_stream_matches_batch(spark):
    root = shared_dir(spark, f"tr-{uuid.uuid4().hex}")
    jobs.run_to_table(jobs.trend(jobs.history_stream(spark, SF, glob="events.parquet")), f"{root}/out",
                      f"{root}/ck")
    out = spark.read.parquet(f"{root}/out")
    assert out.count() > 0
    w = out.orderBy("window_start").first()
    h = history_view(spark, SF)
    lo, hi = w.window_start.date().isoformat(), w.window_end.date().isoformat()
    batch = h.where((F.to_date("timestamp") >= F.lit(lo)) & (F.to_date("timestamp") < F.lit(hi))) \
             .agg(F.avg(F.col("probability") * 100).alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert w.n == batch.n and w.mean_risk_percent == pytest.approx(batch.m)


def test_train_compare_learns_separable_set(spark):
    df = _separable(spark)
    small = {"Logistic Regression": LogisticRegression(maxIter=50, regParam=0.01),
             "Logistic Regression 2": LogisticRegression(maxIter=50, regParam=0.5)}
    results, models, best = ml.train_and_compare(df, ["a", "b"], "label", estimators=small)
    r = {x.model: x for x in results.collect()}
    assert r[best].accuracy >= max(x.accuracy for x in r.values())
    assert r["Logistic Regression"].roc_auc > 0.9
    imp = ml.feature_importance(models["Logistic Regression"], ["a", "b"]).collect()
    assert imp[0].feature == "a"


def test_save_load_same_scores_and_manifest(spark):
    df = _separable(spark)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LogisticRegression(maxIter=20)]).fit(df)
    root = shared_dir(spark, f"m-{uuid.uuid4().hex}")
    save_model(model, f"{root}/logistic_regression")
    again = load_model(f"{root}/logistic_regression")
    p1 = [r.probability for r in ml.score(model, df).collect()]
    p2 = [r.probability for r in ml.score(again, df).collect()]
    assert p1 == p2 and all(0.0 <= p <= 1.0 for p in p1)
    man = {r.model: r.sha256 for r in artifact_manifest(spark, root, ["logistic_regression", "heart_model"]).collect()}
    assert man["heart_model"] == "missing" and len(man["logistic_regression"]) == 64


def test_score_stream_with_failover(spark):
    df = _separable(spark)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LogisticRegression(maxIter=20)]).fit(df)
    root = shared_dir(spark, f"ss-{uuid.uuid4().hex}")
    reqs = df.select("a", "b", F.when(F.col("a") > 10, F.lit("logistic_regression"))
                     .otherwise(F.lit("unknown")).alias("model"))
    reqs.write.json(f"{root}/in")
    q = jobs.score_stream(spark, f"{root}/in", reqs.schema, {"logistic_regression": model, "random_forest": model},
                          {"path": f"{root}/primary", "fmt": "no_such_store"}, {"path": f"{root}/fallback"},
                          f"{root}/ck")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/fallback")
    assert out.count() == 200 and "batch_id" in out.columns
    assert {r.model_used for r in out.select("model_used").distinct().collect()} == {"logistic_regression",
                                                                                     "random_forest"}


def test_score_stream_rejects_and_stamps(spark):
    df = _separable(spark)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LogisticRegression(maxIter=20)]).fit(df)
    root = shared_dir(spark, f"ss-{uuid.uuid4().hex}")
    reqs = df.select("a", F.when(F.col("a") > 10, F.col("b")).alias("b"), F.lit("random_forest").alias("model"))
    reqs.write.json(f"{root}/in")
    stored = []
    jobs.score_stream(spark, f"{root}/in", reqs.schema, {"random_forest": model}, {"path": f"{root}/primary"},
                      {"path": f"{root}/fallback"}, f"{root}/ck", feature_cols=["a", "b"],
                      rejected={"path": f"{root}/rejected"}, model_hashes={"random_forest": "abc"},
                      on_stored=lambda i, sink: stored.append(sink)).awaitTermination()
    n_bad = reqs.where("b IS NULL").count()
    assert 0 < n_bad < 200 and set(stored) == {"primary"}
    assert spark.read.parquet(f"{root}/rejected").count() == n_bad
    out = spark.read.parquet(f"{root}/primary")
    assert out.count() == 200 - n_bad and out.where("model_hash = 'abc'").count() == 200 - n_bad


def test_batch_write_is_idempotent(spark):
    from riskspark.sources import sinks
    root = shared_dir(spark, f"ib-{uuid.uuid4().hex}")
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "record_id long, probability double")
    for _ in range(2):  # the same micro-batch delivered twice
        sinks.append_with_fallback(df, {"path": f"{root}/p"}, {"path": f"{root}/f"}, batch_id=3)
    assert spark.read.parquet(f"{root}/p").count() == 2
