import pytest

from riskspark.operators import evaluate


def _scores(spark, pairs):
    return spark.createDataFrame(pairs, "score double, label int")


def test_auc_edges(spark):
    perfect = _scores(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)])
    reverse = _scores(spark, [(0.9, 0), (0.8, 0), (0.2, 1), (0.1, 1)])
    ties = _scores(spark, [(0.5, 1), (0.5, 0), (0.7, 1), (0.1, 0)])
    one_class = _scores(spark, [(0.5, 1), (0.7, 1)])
    assert evaluate.roc_auc(perfect).collect()[0].roc_auc == 1.0
    assert evaluate.roc_auc(reverse).collect()[0].roc_auc == 0.0
    assert evaluate.roc_auc(ties).collect()[0].roc_auc == pytest.approx(0.875)
    assert evaluate.roc_auc(one_class).collect()[0].roc_auc is None


def test_roc_points(spark):
    pts = evaluate.roc_points(_scores(spark, [(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)])).orderBy("point").collect()
    assert [(p.fpr, p.tpr) for p in pts] == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert pts[0].threshold is None


def test_golden_confusion_metrics(spark):
    # TN=27, FP=2, FN=4, TP=28: the published best-model numbers.
    rows = [(0, 0)] * 27 + [(0, 1)] * 2 + [(1, 0)] * 4 + [(1, 1)] * 28
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = evaluate.classification_metrics(df).collect()[0]
    assert m.accuracy == pytest.approx(0.9016393442622951)
    assert m.precision == pytest.approx(0.9333333333333333)
    assert m.recall == pytest.approx(0.875)
    assert m.f1_score == pytest.approx(0.9032258064516129)
    cells = {(r.actual, r.predicted): r.n for r in evaluate.confusion(df).collect()}
    assert cells == {(0, 0): 27, (0, 1): 2, (1, 0): 4, (1, 1): 28}


def test_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    m = evaluate.classification_metrics(df).collect()[0]
    assert (m.precision, m.f1_score) == (0.0, 0.0)


def test_best_model_first_wins_ties(spark):
    cmp = spark.createDataFrame([("B", 0, 0.9, 0.8), ("A", 1, 0.9, 0.95), ("C", 2, 0.5, 0.99)],
                                "model string, position int, accuracy double, roc_auc double")
    assert evaluate.best_model(cmp).collect()[0].model == "B"
    r = evaluate.rank_models(cmp.drop("position"), "roc_auc").orderBy("rank").collect()
    assert [x.model for x in r] == ["C", "A", "B"] and r[0].pct_of_max == 100.0


def test_roc_partition_invariant_on_table(spark):
    from riskspark.sources.tables import labelled_view
    from .conftest import SF
    l = labelled_view(spark, SF)
    aucs = [evaluate.roc_auc(l, "score", "label", n_buckets=nb).collect()[0].roc_auc for nb in (1, 3, 16)]
    assert aucs[0] == pytest.approx(aucs[1]) and aucs[0] == pytest.approx(aucs[2])
    pts = [sorted((r.point, r.fpr, r.tpr) for r in evaluate.roc_points(l, n_buckets=nb).collect()) for nb in (1, 16)]
    assert pts[0] == pts[1]
