"""Training, scoring and model introspection with ``pyspark.ml``.

Fitted parameters (means, sds, medians) are computed by one distributed aggregation and
applied as column expressions; estimators are ``pyspark.ml`` ones whose fits run as
``treeAggregate`` jobs over the cached training vectors.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import (BOOST_DEPTH, BOOST_ITERS, BOOST_STEP, FOREST_TREES, LOGREG_MAX_ITER,
                       SPLIT_SEED, TEST_FRACTION)
from .clean import column_medians
from .evaluate import best_model, classification_metrics, roc_auc
from .forest import ForestModel, TableForest

#: Split candidates of a feature in the forest (finer than Spark's default of 32).
FOREST_BINS = 256


# ------------------------------------------------------------------ scaling (M1, M2)

def fit_population_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M1: mean and *population* sd of each column (the scaler of the training script,
    not Spark's sample-sd ``StandardScaler``), one aggregation."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).collect()[0]
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]], prefix: str = "") -> DataFrame:
    """M2: (x - mean) / sd; a zero sd leaves the centred value (scale 1)."""
    out = {}
    for c, (m, s) in scaler.items():
        centred = F.col(c) - F.lit(m)
        out[prefix + c] = centred / F.lit(s) if s else centred
    return df.withColumns(out)


def preparation(train: DataFrame, cols: list[str]) -> SQLTransformer:
    """A10 + M1 + M2 as a pipeline stage that is saved with the model: NULL and NaN become the
    fitted rows' exact, interpolated median (T2), then (x - mean) / population sd, into ``_z_*``."""
    known = train.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    medians = {c: m if m is not None else 0.0 for c, m in column_medians(known, cols).items()}
    scaler = fit_population_scaler(known.na.fill(medians), cols)
    parts = []
    for c, (m, s) in scaler.items():
        x = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {float(medians[c])!r}D)"
        parts.append(f"({x} - ({float(m or 0.0)!r}D)) / {float(s or 1.0)!r}D AS `_z_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def logistic_pipeline(spark: SparkSession, cols: list[str], coefficients: list[float], intercept: float) -> PipelineModel:
    """A fitted pipeline from coefficients known beforehand (a model trained elsewhere): raw features
    to P(class 1), saved, loaded and scored like a trained one."""
    fitted = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"LogisticRegression_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(coefficients)), float(intercept))
    model = LogisticRegressionModel(fitted)
    model._resetUid(fitted.uid())
    return PipelineModel([VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error"), model])


# ------------------------------------------------------------------ split

def deterministic_split(df: DataFrame, test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
                        key_expr: Column | None = None, key_cols: list[str] | None = None) -> DataFrame:
    """``split`` = test / train from a hash of the row key, so the assignment does not
    depend on partitioning or recomputation (``randomSplit`` does). ``key_expr`` gives an
    explicit integer key; otherwise ``xxhash64(seed, key_cols)``."""
    if key_expr is None:
        key_cols = key_cols or df.columns
        key_expr = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols])
    test = F.pmod(key_expr, F.lit(100)) < F.lit(int(round(test_fraction * 100)))
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


# ------------------------------------------------------------------ estimators (M3-M5, M9)

def candidate_estimators(n_train: int, seed: int = SPLIT_SEED, features: str = "features",
                         label: str = "label") -> dict[str, object]:
    """The three candidates with the training script's defaults mapped onto Spark:
    C = 1 on a summed loss is regParam = 1 / n on Spark's mean loss; the forest's unbounded
    depth is Spark's cap of 30. A large forest is grown in the tasks and kept as a table (``forest``); a small
    one keeps every row's node in each tree, so a pass does not walk all trees from their roots again."""
    return {
        "Logistic Regression": LogisticRegression(featuresCol=features, labelCol=label, maxIter=LOGREG_MAX_ITER,
                                                  regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                                  standardization=False),
        "Random Forest": TableForest(featuresCol=features, labelCol=label, numTrees=FOREST_TREES,
                                     maxDepth=30, maxBins=FOREST_BINS, featureSubsetStrategy="sqrt",
                                     cacheNodeIds=True, seed=seed),
        "Gradient Boosting": GBTClassifier(featuresCol=features, labelCol=label, maxIter=BOOST_ITERS,
                                           stepSize=BOOST_STEP, maxDepth=BOOST_DEPTH, seed=seed),
    }


def model_key(name: str) -> str:
    """``Random Forest`` -> ``random_forest`` (file / lookup key)."""
    return name.replace(" ", "_").lower()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M6 + M7: ``prediction`` (int) and P(class 1) as ``probability`` (double)."""
    out = model.transform(df)
    return (out.withColumn("prediction", F.col("prediction").cast("int"))
            .withColumn("probability", vector_to_array(F.col("probability"))[1])
            .drop("rawPrediction", "features", *[c for c in out.columns if c.startswith("_z_")]))


def score_by_model(models: dict[str, PipelineModel], df: DataFrame, model_col: str = "model_used") -> DataFrame:
    """M8: each row scored by the pipeline its ``model_col`` names; one filtered pass per model."""
    parts = [score(m, df.where(F.col(model_col) == F.lit(k))) for k, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def train_and_compare(df: DataFrame, feature_cols: list[str], label_col: str = "label",
                      estimators: dict | None = None, test_fraction: float = TEST_FRACTION,
                      seed: int = SPLIT_SEED, key_cols: list[str] | None = None,
                      scale: bool = True, fit_scope: str = "train") -> tuple[DataFrame, dict[str, PipelineModel], str]:
    """M9 + E5 + A18: fit every candidate on the train split, evaluate on the test split,
    pick the best by accuracy (strict ``>``: the first listed wins ties).

    Medians and scales are fitted on the train split, or with ``fit_scope="all"`` on all rows before
    the split, as the training script does (T8); either way they are a stage of every returned
    pipeline, so raw rows are scored as they were trained.

    The candidates do not depend on each other and are fitted and evaluated at once: on small tables a
    fit is hundreds of small jobs that leave most cores idle.

    Returns the comparison frame (model, position, accuracy, precision, recall, f1_score,
    roc_auc), the fitted pipelines and the best model's name.
    """
    from ..session import at_once, shared_dir
    shared_dir(df.sparkSession)  # checkpoint folder for the ensembles' periodic lineage cuts
    data = deterministic_split(df.withColumn(label_col, F.col(label_col).cast("double")),
                               test_fraction, seed, key_cols=key_cols or [*feature_cols, label_col])
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    if fit_scope not in ("train", "all"):
        raise ValueError("fit_scope is train or all")
    train, test = train.persist(), test.persist()
    n_train = train.count()
    before = [preparation(data if fit_scope == "all" else train, feature_cols)] if scale else []
    estimators = estimators or candidate_estimators(n_train, seed, label=label_col)
    inputs = [f"_z_{c}" for c in feature_cols] if scale else feature_cols
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    spark = df.sparkSession

    def fitted(pos: int, name: str, est) -> tuple[PipelineModel, tuple]:
        model = Pipeline(stages=[*before, assembler, est]).fit(train)
        forest = model.stages[-1]
        if isinstance(forest, RandomForestClassificationModel) and not isinstance(forest, ForestModel):  # how it was fitted is not part of the artefact
            for m in (forest, *forest.trees):
                m.clear(m.cacheNodeIds)
        pred = score(model, test).select(label_col, "prediction", "probability").persist()
        m = classification_metrics(pred, label_col, "prediction").select(
            "accuracy", "precision", "recall", "f1_score")
        a = roc_auc(pred, "probability", label_col)
        mrow = m.collect()[0]
        arow = a.collect()[0]
        pred.unpersist()
        return model, (name, pos, mrow["accuracy"], mrow["precision"], mrow["recall"], mrow["f1_score"], arow["roc_auc"])

    done = at_once(spark, [lambda p=p, n=n, e=e: fitted(p, n, e) for p, (n, e) in enumerate(estimators.items())])
    models, rows = dict(zip(estimators, (m for m, _ in done))), [r for _, r in done]
    train.unpersist()
    test.unpersist()
    results = spark.createDataFrame(rows, "model string, position int, accuracy double, precision double, "
                                          "recall double, f1_score double, roc_auc double")
    best = None
    best_acc = 0.0
    for name, pos, acc, *_ in rows:
        if acc is not None and acc > best_acc:
            best, best_acc = name, acc
    return results, models, best or rows[0][0]


def feature_importance(model: PipelineModel, feature_cols: list[str], spark=None) -> DataFrame:
    """Tree importances when the model has them, else |coefficients|; tall and
    ordered by importance (descending)."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        scores, kind = est.featureImportances.toArray().tolist(), "importance"
    elif hasattr(est, "coefficients"):
        scores, kind = [abs(x) for x in est.coefficients.toArray().tolist()], "abs_coefficient"
    else:
        raise ValueError("model has neither importances nor coefficients")
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    rows = [(f, float(s), kind) for f, s in zip(feature_cols, scores)]
    return spark.createDataFrame(rows, "feature string, importance double, kind string") \
                .orderBy(F.desc("importance"), F.asc("feature"))


def importance_table(models: dict[str, PipelineModel], feature_cols: list[str], spark) -> DataFrame:
    """Every model's importances with their shades and :func:`with_ranks`."""
    rows = None
    for name, model in models.items():
        one = minmax_shade(feature_importance(model, feature_cols, spark)).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return with_ranks(rows)


def with_ranks(importances: DataFrame) -> DataFrame:
    """Both orders of (model, feature, importance) as columns, so they survive a union or a write:
    ``rank`` from the largest, ``rank_ascending`` from the smallest as an ascending arg-sort; ties by
    feature. One row per model and feature."""
    down = Window.partitionBy("model").orderBy(F.desc("importance"), F.asc("feature"))
    up = Window.partitionBy("model").orderBy(F.asc("importance"), F.asc("feature"))
    return importances.withColumn("rank", F.row_number().over(down)).withColumn("rank_ascending", F.row_number().over(up))


def run_summary(data: DataFrame, feature_cols: list[str], comparison: DataFrame, metrics: DataFrame, target: str,
                fit_scope: str = "train", test_fraction: float = TEST_FRACTION) -> DataFrame:
    """One row per fact of a training run, ``(section, item, value, number)``: the data set, the
    preparation, the candidates in their order, the selected model and its metrics; a fact is a text
    or a number. ``comparison`` has model, position and accuracy; ``metrics`` one row per model with
    the metrics. Everything is small but the row count, which is one aggregate over ``data``."""
    spark = data.sparkSession
    best = best_model(comparison, "accuracy", "model", "position").select(F.col("model").alias("_best"))
    scope = "train split" if fit_scope == "train" else "all rows"
    fixed = [("dataset", "features", None, float(len(feature_cols))), ("dataset", "target", target, None),
             ("preparation", "missing values", f"median of {scope}", None),
             ("preparation", "scaling", f"mean and population sd of {scope}", None),
             ("preparation", "test share", None, float(test_fraction)), ("selection", "criterion", "highest accuracy", None)]
    rows = spark.createDataFrame(fixed, "section string, item string, value string, number double")

    def fact(df: DataFrame, section: str, item, value=None, number=None) -> DataFrame:
        return df.select(F.lit(section).alias("section"), item.alias("item"),
                         (F.lit(None) if value is None else value).cast("string").alias("value"),
                         (F.lit(None) if number is None else number).cast("double").alias("number"))

    kept = [c for c in metrics.columns if c not in ("model", "position")]
    of_best = metrics.join(F.broadcast(best), F.col("model") == F.col("_best")).select(F.explode(F.array(*[  # one row
        F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("number")) for c in kept])).alias("e"))
    for more in (fact(data.agg(F.count(F.lit(1)).alias("n")), "dataset", F.lit("rows"), number=F.col("n")),
                 fact(comparison, "candidates", F.col("position").cast("string"), value=F.col("model")),
                 fact(best, "selection", F.lit("best model"), value=F.col("_best")),
                 fact(of_best, "metrics", F.col("e.item"), number=F.col("e.number"))):
        rows = rows.unionByName(more)
    return rows


def minmax_shade(df: DataFrame, col: str = "importance", eps: float = 1e-9, base: float = 0.3,
                 span: float = 0.65) -> DataFrame:
    """(x - min) / (max - min + eps) and the shade base + span * n. The input is one row
    per feature, so the whole-frame window covers a handful of rows."""
    w = Window.partitionBy()
    n = (F.col(col) - F.min(col).over(w)) / (F.max(col).over(w) - F.min(col).over(w) + F.lit(eps))
    return df.withColumn("norm", n).withColumn("shade", F.lit(base) + F.lit(span) * F.col("norm"))
