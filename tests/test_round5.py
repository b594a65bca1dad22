"""Findings of round 3 that stayed open: training and artefacts at once, requests converted by compiled columns."""

import threading

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskspark.operators import ml, validate
from riskspark.operators.staged import Staged
from riskspark.session import at_once


class _Meets(Estimator):
    """Fits only when all others are being fitted, too."""

    def __init__(self, barrier, reg):
        super().__init__()
        self.barrier, self.reg = barrier, reg

    def _fit(self, dataset):
        self.barrier.wait(60)  # raises when the others come only after this one has ended
        return LogisticRegression(featuresCol="features", labelCol="label", regParam=self.reg).fit(dataset)


def test_f2_candidates_are_fitted_at_once_and_as_one_by_one(spark):
    rows = [(k, float(k * 37 % 101), float(k * 53 % 89), int(k * k % 7 < 3)) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, label int").coalesce(1)
    barrier = threading.Barrier(3)
    regs = {"one": 0.1, "two": 0.5, "three": 2.0}
    got, models, best = ml.train_and_compare(df, ["a", "b"], estimators={n: _Meets(barrier, r) for n, r in regs.items()}, key_cols=["k"])
    assert list(models) == list(regs)
    rows = got.orderBy("position").collect()
    assert [r.model for r in rows] == list(regs) and best in regs
    for r in rows:
        alone = {r.model: LogisticRegression(featuresCol="features", labelCol="label", regParam=regs[r.model])}
        want, one, _ = ml.train_and_compare(df, ["a", "b"], estimators=alone, key_cols=["k"])
        assert want.drop("position").collect() == [got.drop("position").where(F.col("model") == r.model).first()]
        assert list(one[r.model].stages[-1].coefficients) == list(models[r.model].stages[-1].coefficients)


def test_f2_calls_at_once_keep_order_and_errors(spark):
    meet = threading.Barrier(2)
    assert at_once(spark, [lambda k=k: (meet.wait(60), spark.range(k).count())[1] for k in (3, 5)]) == [3, 5]
    assert at_once(spark, []) == []
    try:
        at_once(spark, [lambda: 1, lambda: 1 // 0])
        raise AssertionError("the error is lost")
    except ZeroDivisionError:
        pass


class _Plans(Staged):
    def write(self, df, name):
        self.plan = df._jdf.queryExecution().optimizedPlan().toString()
        return super().write(df, name)


def test_f6_requests_are_converted_without_interpreted_functions(spark):
    rows = [(1, "1.5", "x", None), (2, "1", "2", "3"), (3, "NaN", "2", "3"), (3, "NaN", "2", "3"), (None, "0", "-1", "1e3"),
            (4, None, "NaN", "1"), (5, "Infinity", " 7 ", "-0"), (6, "", "1", "2"), (7, None, None, None), (8, "1", "2", "NaN")]
    df = spark.createDataFrame(rows, "k long, a string, b string, c string")
    for cols in (["a", "b", "c"], ["c"], ["z", "a"]):
        stage = _Plans(spark, "t")
        two = validate.staged_requests(df, cols, stage)
        assert "transform(" not in stage.plan
        assert stage.plan.count("try_cast(") == len([c for c in cols if c in df.columns])  # each feature once
        for a, b in zip(validate.split_requests(df, cols), two):
            assert a.schema.simpleString() == b.schema.simpleString()
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    typed = df.select("k", F.expr("try_cast(a as double)").alias("a"), F.lit(2).alias("b"))
    for a, b in zip(validate.split_requests(typed, ["a", "b"]), validate.staged_requests(typed, ["a", "b"], Staged(spark, "t"))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
