from pyspark.sql import functions as F

from riskspark.operators import history, validate
from riskspark.schemas import FEATURE_KEYS


def test_flatten_nested_wins_and_defaults(spark):
    df = spark.createDataFrame(
        [("x1", (60.0, None), 50.0, None), ("x2", None, 41.0, "random_forest")],
        "_id string, input_data struct<age:double, chol:double>, age double, model_used string")
    out = history.flatten_nested(df).orderBy("age").collect()
    assert "input_data" not in out[0].asDict() and "_id" not in out[0].asDict()
    assert [r.age for r in out] == [41.0, 60.0]  # nested value wins over top level
    assert set(FEATURE_KEYS) <= set(out[0].asDict())  # absent features exist as NULL
    assert {r.model_used for r in out} == {"unknown", "random_forest"}


def test_union_history(spark):
    a = spark.createDataFrame([(1, "lr", 0.2)], "record_id long, model_used string, probability double")
    b = spark.createDataFrame([(2, 0.7)], "record_id long, probability double")
    u = {r.record_id: (r.source, r.model_used) for r in history.union_history(a, b).collect()}
    assert u == {1: ("primary", "lr"), 2: ("fallback", "unknown")}


def test_quarantine_and_model_choice(spark):
    df = spark.createDataFrame([("1.5", "2", "gradient_boosting"), ("abc", None, "svm")],
                               "a string, b string, model string")
    q = validate.quarantine(df, ["a", "b"]).withColumn("chosen", validate.choose_model("model")).collect()
    assert q[0].valid and q[0].chosen == "gradient_boosting"
    assert not q[1].valid and q[1].bad_features == ["a", "b"] and q[1].chosen == "random_forest"


def test_rule_violations(spark):
    from riskspark.schemas import FORM_RULES
    df = spark.createDataFrame([(130.0, 5.0), (50.0, 2.0), (None, 9.0)], "age double, cp double")
    rules = [r for r in FORM_RULES if r[0] in ("age", "cp")]
    got = [r.violations for r in validate.rule_violations(df, rules).collect()]
    assert got == [["age", "cp"], [], ["cp"]]
