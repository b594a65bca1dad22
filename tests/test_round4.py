"""Findings of round 3: validation in front of scoring."""

from pyspark.sql import functions as F

from riskspark.operators import validate


def test_f2_a_filter_on_bad_features_converts_each_feature_once(spark):
    rows = [(1, "1.5", "x", None), (2, "1", "2", "3"), (3, "NaN", "2", "3"), (3, "NaN", "2", "3"), (None, "0", "-1", "1e3")]
    df = spark.createDataFrame(rows, "k long, a string, b string, c string")
    good, bad = validate.split_requests(df, ["a", "b", "c"])
    assert sorted((r.k or 0, r.a, r.b, r.c) for r in good.collect()) == [(0, 0.0, -1.0, 1000.0), (2, 1.0, 2.0, 3.0)]
    assert sorted((r.k, r.bad_features) for r in bad.collect()) == [(1, ["b", "c"]), (3, ["a"]), (3, ["a"])]
    # Converted in the pushed filter and for the output; not once more for every feature asked about.
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("try_cast(") <= 2
    q = {r.k: r.bad_features for r in validate.quarantine(df.where("k < 3"), ["a", "b", "c"]).collect()}
    assert q == {1: ["b", "c"], 2: []}
    assert validate.split_requests(df, ["a", "z"])[1].where(F.array_contains("bad_features", "z")).count() == 5


def test_f2_requests_with_many_features_are_planned_and_scored(spark):
    from pyspark.ml import PipelineModel

    from riskspark.operators import ml
    from riskspark.operators.staged import Staged
    cols = [f"f{i}" for i in range(64)]
    src = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.col("id") / 100.0).alias("e"))
    nums = src.select("id", *[F.col("e")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    reqs = nums.select("id", F.when(F.col("id") % 10 == 3, F.lit("n/a")).otherwise(F.col("f0").cast("string")).alias("f0"),
                       *[F.col(c).cast("string") for c in cols[1:]],
                       F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("model_used"))
    prep = ml.preparation(nums, cols)
    models = {k: PipelineModel([prep, *ml.logistic_pipeline(spark, [f"_z_{c}" for c in cols], [0.1 * s] * 64, 0.2).stages])
              for k, s in (("a", 1), ("b", -1))}
    good, bad = validate.staged_requests(reqs, cols, Staged(spark, "t"))
    want = {r.id: r.probability for k, odd in (("a", 0), ("b", 1)) for r in ml.score(models[k], nums.where(F.col("id") % 2 == odd)).collect()}
    got = {r.id: r.probability for r in ml.score_by_model(models, good).collect()}  # planning this did not end before
    assert got == {k: p for k, p in want.items() if k % 10 != 3}
    assert sorted((r.id, r.f0, r.f1 is not None, r.bad_features) for r in bad.collect()) == [(k, "n/a", True, ["f0"]) for k in (3, 13, 23, 33)]


def test_f2_staged_requests_equal_split_requests(spark):
    from riskspark.operators.staged import Staged
    rows = [(1, "1.5", "x", None), (2, "1", "2", "3"), (3, "NaN", "2", "3"), (3, "NaN", "2", "3"), (None, "0", "-1", "1e3")]
    df = spark.createDataFrame(rows, "k long, a string, b string, c string")
    for cols in (["a", "b", "c"], ["a"], ["a", "z"]):
        for one, two in zip(validate.split_requests(df, cols), validate.staged_requests(df, cols, Staged(spark, "t"))):
            assert one.schema.simpleString() == two.schema.simpleString()
            assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_f6_each_request_is_converted_once(spark):
    from riskspark.plans import queries

    from .conftest import SF
    plan = queries.Q["score_requests"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast(" not in plan and "l_orderkey" in plan  # models and rejects read the converted table


def test_f5_a_batch_is_parsed_and_converted_once(spark, monkeypatch):
    import uuid

    from riskspark.operators import ml
    from riskspark.session import shared_dir
    from riskspark.streaming import jobs
    root = shared_dir(spark, f"f5-{uuid.uuid4().hex}")
    reqs = spark.createDataFrame([(1, "1", "2", "m"), (2, "x", "2", "m"), (3, "0", None, "n"), (4, "3", "1", "n")],
                                 "k long, a string, b string, model string")
    reqs.write.json(f"{root}/in")
    models = {k: ml.logistic_pipeline(spark, ["a", "b"], [0.5, s], 0.1) for k, s in (("m", 1.0), ("random_forest", -1.0))}
    plans = []
    real = jobs.append_with_fallback
    monkeypatch.setattr(jobs, "append_with_fallback",
                        lambda df, *a, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a, **k))[1])
    for _ in range(2):  # started again with more input: the second run scores the new rows only
        jobs.score_stream(spark, f"{root}/in", reqs.schema, models, {"path": f"{root}/p"}, {"path": f"{root}/f"}, f"{root}/ck",
                          feature_cols=["a", "b"], rejected={"path": f"{root}/bad"}).awaitTermination()
        reqs.withColumn("k", F.col("k") + 10).write.mode("append").json(f"{root}/in")
    assert plans and all("try_cast(" not in p for p in plans)
    assert sorted(r.k for r in spark.read.parquet(f"{root}/p").collect()) == [1, 4, 11, 14]
    assert sorted(r.k for r in spark.read.parquet(f"{root}/bad").collect()) == [2, 3, 12, 13]


def test_f3_forest_keeps_node_ids_and_grows_the_same_trees(spark):
    from pyspark.ml.feature import VectorAssembler

    from riskspark.operators import ml
    rows = [(k, float(k * 37 % 101), float(k * 53 % 89), int(k * k % 7 < 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, label int").coalesce(1)
    forest = ml.candidate_estimators(400)["Random Forest"]
    assert forest.getCacheNodeIds()  # not set before: each pass walked every tree from its root for every row
    few = {"Random Forest": forest.copy().setNumTrees(5)}
    model = ml.train_and_compare(df, ["a", "b"], estimators=few, key_cols=["k"], scale=False)[1]["Random Forest"].stages[-1]
    train = ml.deterministic_split(df, key_cols=["k"]).where("split = 'train'").withColumn("label", F.col("label").cast("double"))
    plain = forest.copy().setNumTrees(5).setCacheNodeIds(False).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(train))
    assert model.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
    assert not model.isSet("cacheNodeIds")
    for m in (model, *model.trees):  # the model and its trees are saved without it
        assert not m._java_obj.isSet(m._java_obj.getParam("cacheNodeIds"))
