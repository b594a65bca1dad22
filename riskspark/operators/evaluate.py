"""Model evaluation and comparison.

Counts are one aggregation; ROC/AUC run over scores grouped to distinct values first and
then a bucketed prefix sum in descending score order, so neither the rows nor the distinct
scores pass through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small
from .ordered import IDX, global_prefix, grouped_prefix, null_safe
from .staged import Staged


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """``(actual, predicted, n)`` for all four cells, zeros included; any other label or
    prediction in the data keeps a row of its own, so the cells sum to the number of rows."""
    counts = df.groupBy(F.col(label_col).cast("int").alias("actual"),
                        F.col(pred_col).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)],
                                            "actual int, predicted int")
    zeros = cells.withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(zeros).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                           group_cols: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0), optionally per group."""
    y, p = F.col(label_col), F.col(pred_col)
    g = list(group_cols or [])
    c = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return (c.withColumn("accuracy", ratio(tp + tn, F.col("n")))
            .withColumn("precision", ratio(tp, tp + fp))
            .withColumn("recall", ratio(tp, tp + fn))
            .withColumn("f1_score", ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)))


def _roc_frame(df: DataFrame, score_col: str, label_col: str, group_cols: list[str],
               n_buckets: int | None) -> DataFrame:
    """Per (group, distinct score): tp/fp, inclusive running cum_tp/cum_fp in descending
    score order, and the group's class sizes n_pos / n_neg."""
    s, y = F.col(score_col), F.col(label_col)
    clean = df.where(s.isNotNull() & y.isNotNull())
    grouped = clean.groupBy(*group_cols, score_col).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("fp"))
    # Read twice (order and totals): the distinct scores are counted once.
    grouped = Staged(df.sparkSession, "roc").write(grouped.withColumn("_neg", -F.col(score_col)), "scores")
    if group_cols:
        ranked = grouped_prefix(grouped, group_cols, ["_neg"], ["tp", "fp"], n_buckets=n_buckets)
        ranked = ranked.withColumnRenamed("_gcum_tp", "cum_tp").withColumnRenamed("_gcum_fp", "cum_fp") \
                       .withColumnRenamed("_gidx", "point")
        totals = grouped.groupBy(*[F.col(c).alias(f"_t_{c}") for c in group_cols]).agg(
            F.sum("tp").alias("n_pos"), F.sum("fp").alias("n_neg"))
        known = broadcast_if_small(Staged(df.sparkSession, "roc").write(totals, "totals"))  # a row per group
        return ranked.join(known, null_safe(group_cols, [f"_t_{c}" for c in group_cols])).drop(*[f"_t_{c}" for c in group_cols])
    ranked = global_prefix(grouped, ["_neg"], ["tp", "fp"], n_buckets=n_buckets)
    ranked = (ranked.withColumnRenamed("_cum_tp", "cum_tp").withColumnRenamed("_cum_fp", "cum_fp")
              .withColumnRenamed(IDX, "point").drop("_cnt_tp", "_cnt_fp"))
    tot = grouped.agg(F.sum("tp"), F.sum("fp")).collect()[0]
    return ranked.withColumn("n_pos", F.lit(tot[0] or 0)).withColumn("n_neg", F.lit(tot[1] or 0))


def roc_points(df: DataFrame, score_col: str = "score", label_col: str = "label",
               group_cols: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """One ROC point per distinct score (descending), plus the origin (point 0,
    NULL threshold); fpr/tpr are NULL when a class is absent."""
    g = list(group_cols or [])
    r = _roc_frame(df, score_col, label_col, g, n_buckets)
    pts = r.select(*g, F.col("point").cast("long").alias("point"), F.col(score_col).cast("double").alias("threshold"),
                   F.try_divide(F.col("cum_fp").cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
                   F.try_divide(F.col("cum_tp").cast("double"), F.col("n_pos").cast("double")).alias("tpr"))
    origin_src = r.groupBy(*g).agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    origin = origin_src.select(*g, F.lit(0).cast("long").alias("point"), F.lit(None).cast("double").alias("threshold"),
                               F.when(F.col("n_neg") > 0, F.lit(0.0)).alias("fpr"),
                               F.when(F.col("n_pos") > 0, F.lit(0.0)).alias("tpr"))
    return origin.unionByName(pts)


def roc_auc(df: DataFrame, score_col: str = "score", label_col: str = "label",
            group_cols: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Trapezoid area under the ROC curve. For a distinct score with (tp, fp) and
    inclusive running TP, the trapezoid is fp/N * (2 TP - tp) / (2 P); the sum needs no lag.
    NULL when one class is absent."""
    g = list(group_cols or [])
    r = _roc_frame(df, score_col, label_col, g, n_buckets)
    area = F.col("fp").cast("double") * (F.lit(2.0) * F.col("cum_tp") - F.col("tp"))
    return r.groupBy(*g).agg(
        F.try_divide(F.sum(area), F.lit(2.0) * F.first("n_pos").cast("double") * F.first("n_neg").cast("double"))
        .alias("roc_auc"))


def compare_models(scored_tall: DataFrame, model_col: str = "model", score_col: str = "score",
                   label_col: str = "label", threshold: float = 0.5) -> DataFrame:
    """E5: per model (NULL is one) accuracy and ROC-AUC from a tall (model, label, score) frame."""
    pred = scored_tall.withColumn("prediction", (F.col(score_col) > F.lit(threshold)).cast("int"))
    acc = classification_metrics(pred, label_col, "prediction", [model_col]).select(model_col, "accuracy")
    auc = roc_auc(scored_tall, score_col, label_col, [model_col])
    auc = auc.withColumnRenamed(model_col, "_model")
    return acc.join(auc, F.col(model_col).eqNullSafe(F.col("_model"))).drop("_model")


def best_model(comparison: DataFrame, metric: str = "accuracy", model_col: str = "model",
               position_col: str | None = "position") -> DataFrame:
    """The row with the highest metric; ties go to the earliest position (the
    strict ``>`` of a running maximum), else the smallest name. A top-1, not a full sort."""
    ties = [F.asc(position_col)] if position_col else []
    return comparison.orderBy(F.desc_nulls_last(metric), *ties, F.asc(model_col)).limit(1)


def rank_models(comparison: DataFrame, metric: str = "accuracy", model_col: str = "model") -> DataFrame:
    """Rank (1 = best) by metric descending, name ascending, and the value as a
    percentage of the maximum. The comparison table has one row per model (a handful), so
    its window is tiny."""
    w = Window.orderBy(F.desc(metric), F.asc(model_col))
    return (comparison.withColumn("rank", F.row_number().over(w))
            .withColumn("pct_of_max", F.col(metric) * F.lit(100.0) / F.max(metric).over(Window.partitionBy()))
            .withColumn("rank_label", F.concat(F.lit("#"), F.col("rank").cast("string"))))
