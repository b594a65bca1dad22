"""Ordered and ranked statistics, validation, stores, manifests and histories: cases with known answers."""

import math
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import clean, evaluate, history, ml, ordered, quantiles, stats, validate
from riskspark.schemas import FEATURE_KEYS
from riskspark.session import shared_dir
from riskspark.sources import artifacts, sinks
from riskspark.sources.tables import history_view
from riskspark.streaming import jobs

from .conftest import SF


# ---------------------------------------------------------------- W1, W4, O2

@pytest.mark.parametrize("window,block", [(1, 4), (3, 250_000), (7, 3), (10, 10), (16, 3), (50, 4), (64, 5), (997, 10), (2000, 7)])
def test_rolling_mean_by_blocks_of_any_size(spark, window, block):
    g = np.random.Generator(np.random.PCG64(window))
    v = [None if x < 0.2 else float("nan") if x < 0.25 else float(x) for x in g.random(211)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v double")
    got = ordered.rolling_mean(df, "v", ["id"], window=window, block=block).orderBy("row_index").collect()
    want = pd.Series(v, dtype=float).rolling(window, min_periods=1).mean()
    assert [r.row_index for r in got] == list(range(1, 212))
    assert [r.rolling_mean if r.rolling_mean is not None else math.nan for r in got] == pytest.approx(list(want), nan_ok=True)


def test_rolling_mean_forgets_what_left_the_frame(spark):
    v = [1e16] + [0.1] * 40 + [float("inf")] + [0.1] * 40
    df = spark.createDataFrame(list(enumerate(v)), "id long, v double")
    for block in (3, 250_000):
        got = [r.rolling_mean for r in ordered.rolling_mean(df, "v", ["id"], window=5, block=block).orderBy("row_index").collect()]
        assert got[5:41] == pytest.approx([0.1] * 36, rel=1e-12)
        assert got[41:46] == [math.inf] * 5
        assert got[46:] == pytest.approx([0.1] * 36, rel=1e-12)


def test_global_order_uses_several_buckets_and_one_small_offsets_table(spark):
    h = history_view(spark, SF).select("record_id", "timestamp")
    rows = ordered.pinned_order(h, ["timestamp", "record_id"])
    sizes = {r[0]: r[1] for r in rows.groupBy("_bucket").count().collect()}
    assert len(sizes) >= 4 and max(sizes.values()) < 1000 / 2
    out = ordered.global_row_index(h, ["timestamp", "record_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BroadcastHashJoin" in plan and "Window" not in plan
    assert "from_json" not in plan  # offsets are a table, no literal
    want = [r.record_id for r in h.orderBy("timestamp", "record_id").collect()]
    assert [r.record_id for r in out.orderBy("row_index").collect()] == want


def test_empty_input_of_ordered_operators(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert ordered.rolling_mean(df, "v", ["id"]).count() == 0
    assert ordered.global_row_index(df, ["id"]).count() == 0
    assert quantiles.exact_quantiles(df, "v", [0.5], moments=True).count() == 0


# ---------------------------------------------------------------- A7, A10, A14, A15, A12

HARD = [0.0, -0.0, 1e-320, -1e-320, 5e-324, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, -1.0, -1.0 - 2**-52, 1e300, -1e300, 3.5, 3.5, 3.5]


def _numpy_quantile(vals, p):
    s = sorted(vals)
    at = p * (len(s) - 1)
    lo, hi = s[math.floor(at)], s[math.ceil(at)]
    return lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))


@pytest.mark.parametrize("coarse,parts", [(quantiles.COARSE, quantiles.PARTS), (1, 8), (1, 1)])
def test_quantiles_of_neighbouring_and_extreme_doubles(spark, coarse, parts):
    g = np.random.Generator(np.random.PCG64(5))
    near = [1.0 + k * 2.0**-52 for k in g.integers(0, 300, 400)]
    groups = {"hard": HARD, "near": near, None: list(g.standard_normal(333) * 10.0 ** g.integers(-9, 9, 333)), "one": [7.25]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("none", math.nan), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in quantiles.exact_quantiles(df, "v", probs, group_cols=["g"], coarse=coarse, parts=parts).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        assert [got[k][f"q{int(round(p * 100))}"] for p in probs] == [_numpy_quantile(vs, p) for p in probs]


def test_quantiles_never_sort_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 7).alias("g"), (F.col("id") * 0.37).alias("v"))
    stage = []
    real = quantiles.Staged.write
    try:
        quantiles.Staged.write = lambda self, d, name: stage.append((name, d._jdf.queryExecution().executedPlan().toString())) or real(self, d, name)
        quantiles.exact_quantiles(df, "v", [0.5], group_cols=["g"]).collect()
    finally:
        quantiles.Staged.write = real
    assert len(stage) <= 3
    for name, plan in stage:  # every sort stands above an aggregate: it orders a histogram
        for line in plan.split("\n"):
            if " Sort " in line:
                assert plan.index(line) < plan.index("HashAggregate")


def test_median_impute_of_many_columns(spark):
    pdf = pd.DataFrame({f"c{i}": [float((j * (i + 3)) % 17) if (j + i) % 5 else None for j in range(60)] for i in range(8)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in pdf))
    got = clean.median_impute(df, list(pdf)).toPandas()
    want = pdf.fillna(pdf.median())
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_box_and_outliers_keep_the_null_group(spark):
    rows = [(i, None if i % 2 else "a", float(i % 10)) for i in range(100)] + [(100, None, 500.0), (101, "a", -500.0)]
    df = spark.createDataFrame(rows, "record_id long, g string, v double")
    assert {r.g: r.n_outliers for r in stats.box_stats(df, "v", "g").collect()} == {None: 1, "a": 1}
    assert {r.record_id for r in stats.outliers(df, "record_id", "v", "g").collect()} == {100, 101}


def test_density_equals_the_direct_sum(spark):
    g = np.random.Generator(np.random.PCG64(9))
    values = {"a": g.standard_normal(500) * 3 + 40, None: np.concatenate([g.exponential(5, 400), [400.0]])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("flat", 1.0), ("flat", 1.0)], "g string, v double")
    got = stats.density(df, "v", "g", points=50).toPandas()
    assert set(got.g.astype(object).where(got.g.notna(), None)) == {"a", None} and len(got) == 100
    for k, vs in values.items():
        mine = got[got.g.isna() if k is None else got.g == k].sort_values("k")
        iqr = np.quantile(vs, 0.75) - np.quantile(vs, 0.25)
        bw = 0.9 * min(np.std(vs, ddof=1), iqr / 1.349) * len(vs) ** -0.2
        x = np.linspace(vs.min(), vs.max(), 50)
        want = np.exp(-0.5 * ((x[:, None] - vs[None, :]) / bw) ** 2).sum(1) / (len(vs) * bw * math.sqrt(2 * math.pi))
        assert mine.x.values == pytest.approx(x)
        assert np.abs(mine.density.values - want).max() < 1e-12


def test_correlation_is_pairwise_complete_and_stable(spark):
    g = np.random.Generator(np.random.PCG64(4))
    x = g.standard_normal((400, 14)) @ g.standard_normal((14, 14)) + 1e8
    x[g.random(x.shape) < 0.2] = np.nan
    x[:, 13] = 5.0
    cols = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame([[None if math.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)] for r in x],
                               ", ".join(f"{c} double" for c in cols))
    got = {(r.x, r.y): r.r for r in stats.corr_matrix(df, cols).collect()}
    want = pd.DataFrame(x, columns=cols).corr()
    assert len(got) == 196
    for (a, b), r in got.items():
        assert (r is None) if "c13" in (a, b) else r == pytest.approx(want.loc[a, b], abs=1e-7)
    none = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert {r.r for r in stats.corr_matrix(none, ["a", "b"]).collect()} == {None}


# ---------------------------------------------------------------- E5, M9, M11, T2

def test_comparison_of_an_unnamed_model(spark):
    df = spark.createDataFrame([(m, i % 2, (i % 2) * 0.6 + 0.1) for m in ("a", None) for i in range(10)], "model string, label int, score double")
    got = {r.model: (r.accuracy, r.roc_auc) for r in evaluate.compare_models(df).collect()}
    assert got == {"a": (1.0, 1.0), None: (1.0, 1.0)}
    assert {r.model for r in evaluate.roc_points(df, group_cols=["model"]).collect()} == {"a", None}


def test_preparation_uses_interpolated_medians_of_its_scope(spark):
    from pyspark.ml.classification import LogisticRegression
    rows = [(i, None if i % 4 == 0 else float(i), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, label int")
    stage = ml.preparation(df, ["a"])
    med = pd.Series([r[1] for r in rows], dtype=float).median()
    filled = pd.Series([med if r[1] is None else r[1] for r in rows])
    z = [r["_z_a"] for r in stage.transform(df).orderBy("id").collect()]
    assert z == pytest.approx(list((filled - filled.mean()) / filled.std(ddof=0)))
    fits = {}
    for scope in ("train", "all"):
        _, models, _ = ml.train_and_compare(df, ["a"], estimators={"lr": LogisticRegression(labelCol="label", maxIter=5)},
                                            key_cols=["id"], fit_scope=scope)
        fits[scope] = models["lr"].stages[0].getStatement()
    assert fits["all"] == stage.getStatement() and fits["train"] != fits["all"]
    with pytest.raises(ValueError):
        ml.train_and_compare(df, ["a"], fit_scope="none")


def test_forest_has_256_bins():
    assert ml.candidate_estimators(10)["Random Forest"].getMaxBins() == 256


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("t"))
    one = {r.id: r.split for r in ml.deterministic_split(df.coalesce(1), key_cols=["id"]).collect()}
    many = {r.id: r.split for r in ml.deterministic_split(df.repartition(7, "t"), key_cols=["id"]).collect()}
    assert one == many and 0.16 < sum(s == "test" for s in one.values()) / 3000 < 0.24


def test_importance_orders_survive(spark):
    df = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5), ("m", "c", 0.9), ("n", "a", 0.1)], "model string, feature string, importance double")
    got = {(r.model, r.feature): (r.rank, r.rank_ascending) for r in ml.with_ranks(df).collect()}
    assert got == {("m", "c"): (1, 3), ("m", "a"): (2, 1), ("m", "b"): (3, 2), ("n", "a"): (1, 1)}


# ---------------------------------------------------------------- P6, P25, P26, P27

def test_requests_with_64_features_are_split_quickly(spark):
    cols = [f"f{i}" for i in range(64)]
    row = ["1.5"] * 64
    rows = [(i, *row) for i in range(200)]
    rows[3] = (3, *row[:10], "abc", *row[11:])
    rows[4] = (4, None, *row[1:63], "NaN")
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in cols))
    t = time.time()
    good, bad = validate.split_requests(df, cols)
    summed = good.select("id", sum(F.col(c) for c in cols).alias("s")).collect()
    assert len(summed) == 198 and {r.s for r in summed} == {96.0}
    assert {r.id: r.bad_features for r in bad.collect()} == {3: ["f10"], 4: ["f0", "f63"]}
    assert time.time() - t < 20
    good, bad = validate.split_requests(df.drop("f7"), cols)
    assert good.count() == 0 and {r.bad_features[0] for r in bad.where("id > 4").collect()} == {"f7"}


def test_form_codes(spark):
    df = spark.createDataFrame([(1, 0, 3), (7, None, 1)], "sex int, cp int, thal int")
    got = validate.decode_codes(df, [("sex", 1, "Male"), ("cp", 0, "Typical"), ("thal", 3, "Unknown")]).collect()
    assert [(r.sex_label, r.cp_label, r.thal_label) for r in got] == [("Male", "Typical", "Unknown"), (None, None, None)]


# ---------------------------------------------------------------- P10-P15, O1

def test_strict_defaults_tell_absent_from_null(spark):
    texts = ['{"model_used": null, "age": 5}', '{"age": "6", "input_data": {"age": null}}', '{"model_used": "m", "input_data": {"age": 8}}',
             "not json", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    strict = {r.i: (r.age, r.model_used) for r in history.normalise_json(df, keys=["age"], carry=["i"]).collect()}
    assert strict == {0: (5.0, None), 1: (None, "unknown"), 2: (8.0, "m"), 3: (None, "unknown"), 4: (None, "unknown"), 5: (None, "unknown")}
    filled = {r.i: r.model_used for r in history.normalise_json(df, keys=["age"], carry=["i"], strict=False).collect()}
    assert filled[0] == "unknown" and filled[2] == "m"


def test_union_completes_both_sides_and_parses_times(spark):
    p = spark.sql("SELECT 1 AS record_id, 50D AS age, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS timestamp, 'm' AS model_used")
    f = spark.sql("SELECT 2 AS record_id, 'x' AS _id, named_struct('age', 61D) AS input_data, '2024-01-02T03:04:05.5' AS timestamp")
    u = history.union_history(p, f)
    assert set(FEATURE_KEYS) <= set(u.columns) and "_id" not in u.columns
    got = {r.record_id: (r.age, str(r.timestamp), r.model_used, r.source) for r in u.collect()}
    assert got == {1: (50.0, "2024-01-01 10:00:00", "m", "primary"), 2: (61.0, "2024-01-02 03:04:05.500000", "unknown", "fallback")}


# ---------------------------------------------------------------- K3, S8, R2

def _rows(spark, ids):
    return spark.createDataFrame([(i, 0.5) for i in ids], "record_id long, probability double")


def test_primary_that_fails_in_its_commit(spark):
    root = shared_dir(spark, f"k3-{uuid.uuid4().hex}")
    p, f = {"path": f"{root}/p"}, {"path": f"{root}/f"}

    def lost(spark, path, write_id):
        if path == p["path"]:
            raise IOError("gone")
        sinks.commit(spark, path, write_id)

    def late(spark, path, write_id):
        sinks.commit(spark, path, write_id)
        raise IOError("answer lost")

    seen = lambda: sorted((r.record_id, r.source) for r in sinks.read_stored(spark, p["path"], f["path"]).collect())
    assert sinks.read_stored(spark, p["path"], f["path"]) is None
    out = sinks.append_with_fallback(_rows(spark, [1, 2]), p, f, commit=lost)
    assert out == "fallback" and "gone" in out.reason and seen() == [(1, "fallback"), (2, "fallback")]
    assert sinks.append_with_fallback(_rows(spark, [3]), p, f, commit=late) == "primary"
    sinks.append_with_fallback(_rows(spark, [4]), p, f, batch_id=9, commit=lost)
    assert sinks.append_with_fallback(_rows(spark, [4]), p, f, batch_id=9) == "primary"  # delivered again
    assert seen() == [(1, "fallback"), (2, "fallback"), (3, "primary"), (4, "primary")]
    bad = {"path": f"{root}/x", "fmt": "no_such_store"}
    with pytest.raises(RuntimeError, match="neither"):
        sinks.append_with_fallback(_rows(spark, [5]), bad, bad)


def test_manifest_is_of_the_content(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    root = shared_dir(spark, f"s8-{uuid.uuid4().hex}")
    one, other = [ml.logistic_pipeline(spark, ["a", "b"], [0.25, c], -1.0) for c in (0.5, 0.5000001)]
    df = spark.createDataFrame([(float(i % 7), float(i % 5), i % 2) for i in range(60)], "a double, b double, label int")
    forest = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), RandomForestClassifier(numTrees=3, seed=1)])
    trees, more = forest.fit(df), forest.copy({forest.getStages()[1].seed: 2}).fit(df)
    for name, m in (("x", one), ("y", one), ("z", other), ("t", trees), ("u", trees), ("v", more)):
        artifacts.save_model(m, f"{root}/{name}")
    artifacts.save_model(artifacts.load_model(f"{root}/x"), f"{root}/again")
    sha = {r.model: r.sha256 for r in artifacts.artifact_manifest(spark, root, ["x", "y", "z", "t", "u", "v", "again", "w"]).collect()}
    assert sha["x"] == sha["y"] == sha["again"] != sha["z"] and sha["t"] == sha["u"] != sha["v"] and sha["w"] == "missing"


def test_live_kpis_equal_batch_and_replay_changes_nothing(spark):
    root = shared_dir(spark, f"r2-{uuid.uuid4().hex}")
    src = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    days = [r.d for r in src.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    half = days[len(days) // 2]
    for k, cond in enumerate((F.to_date("ts") <= F.lit(half), F.to_date("ts") >= F.lit(half))):  # one day in both files
        part = src.where(cond & ((F.col("event_id") % 2 == k) | (F.to_date("ts") != F.lit(half))))
        part.coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
        live = jobs.stream_live_kpis(spark, root, glob="events.parquet", out_root=f"{root}/out")
    want = {r.d: (r.n, r.m) for r in history_view(spark, SF).groupBy(F.to_date("timestamp").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("m")).collect()}
    got = {r.day.date(): (r.total, r.avg_probability) for r in live.collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-12 for d in want)
    write = jobs.upsert_days(f"{root}/out/live_kpis")
    before = sorted(map(tuple, live.collect()))
    batch = spark.createDataFrame(
        live.where(F.to_date("day") == F.lit(half)).collect(), live.schema)
    write(batch, 7)
    write(batch, 7)
    again = spark.read.parquet(f"{root}/out/live_kpis")
    assert sorted(map(tuple, again.drop("kpi_day").collect())) == before
