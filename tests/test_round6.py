"""Findings of round 4: forests grown in the tasks and kept as tables."""

import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskspark.operators import forest, ml
from riskspark.session import shared_dir
from riskspark.sources import artifacts

COLS = ["a", "b", "c", "d", "e"]


def _frame(spark, n=700):
    rows = [(k, float(k * 37 % 101), float(k * 53 % 89), float(k * k % 31), 1.5, float(k % 3), float((k * k % 7 < 3) + (k % 11 == 0))) for k in range(n)]
    rows += rows[:40]  # rows that come twice
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, e double, label double").coalesce(1)


def _rows(spark):
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(_frame(spark))


def _forest(trees=4, depth=30, seed=7):
    return ml.candidate_estimators(1, seed)["Random Forest"].copy().setNumTrees(trees).setMaxDepth(depth)


@pytest.fixture
def grown(monkeypatch):
    monkeypatch.setattr(forest, "TABLE_ROWS", 10)
    monkeypatch.setattr(forest, "DRIVER_NODES", 0)


def _plain_tree(x, y, w, key, depth, k, most):
    """(feature, threshold, left, right) or the counts of a leaf; one node after the other."""
    def gini(c):
        n = sum(c)
        return 1 - sum((v / n) ** 2 for v in c)

    total = [sum(a for a, b in zip(w, y) if b == c) for c in range(k)]
    best = (0.0, None)
    if depth < most and sum(v > 0 for v in total) > 1:
        for f in forest._subsets(np.array([key], np.uint64), len(COLS), 3)[0]:
            for lo, hi in zip(v := sorted({r[f] for r, n in zip(x, w) if n}), v[1:]):
                left = [sum(n for r, n, b in zip(x, w, y) if b == c and r[f] <= lo) for c in range(k)]
                right = [a - b for a, b in zip(total, left)]
                gain = gini(total) - sum(left) / sum(total) * gini(left) - sum(right) / sum(total) * gini(right)
                if gain > best[0]:  # the same sums in the same order
                    best = (gain, (int(f), lo))
    if best[1] is None:
        return total
    f, lo = best[1]
    sides = []
    for right in (False, True):
        m = [i for i in range(len(x)) if (x[i][f] > lo) == right]
        sides.append(_plain_tree([x[i] for i in m], [y[i] for i in m], [w[i] for i in m], forest._child_keys(np.array([key], np.uint64), right)[0], depth + 1, k, most))
    if all(isinstance(s, list) for s in sides) and np.argmax(sides[0]) == np.argmax(sides[1]):
        return total
    return f, lo, *sides


def _same(tree, nodes, at, seen, points):
    n = nodes[at]
    seen[at] += 1
    if isinstance(tree, list):
        assert n.leftChild == n.rightChild == -1 and n.split.featureIndex == -1 and list(n.impurityStats) == tree
        assert n.rawCount == sum(tree) and n.prediction == float(np.argmax(tree)) and n.gain == -1.0
        return tree
    edge = n.split.leftCategoriesOrThreshold[0]
    assert n.split.featureIndex == tree[0] and tree[1] < edge and not any(tree[1] < v < edge for v in points[tree[0]])
    total = [a + b for a, b in zip(_same(tree[2], nodes, n.leftChild, seen, points), _same(tree[3], nodes, n.rightChild, seen, points))]
    assert list(n.impurityStats) == total and n.leftChild > at and n.rightChild > at
    return total


@pytest.mark.parametrize("most,depth", [(60, 30), (100_000, 30), (60, 4)])
def test_f1_f2_trees_are_those_of_a_plain_version(spark, grown, monkeypatch, most, depth):
    monkeypatch.setattr(forest, "SUBTREE_ROWS", most)
    monkeypatch.setattr(forest, "OPEN_NODES", 3)
    df = _rows(spark)
    model = _forest(trees=2, depth=depth).fit(df)
    rows = df.select(*COLS, "label").collect()
    x, y = [r[:5] for r in rows], [int(r.label) for r in rows]
    points = [sorted({r[f] for r in x}) for f in range(5)]
    for t in range(2):
        key = forest._tree_key(7, t)
        w = forest._weights(forest._mix(key), np.arange(len(rows))).tolist()
        assert 0.9 < np.mean(w) < 1.1 and max(w) > 2
        nodes = {r.nodeData.id: r.nodeData for r in model.nodes().where(F.col("treeID") == t).collect()}
        seen = Counter()
        _same(_plain_tree(x, y, w, key, 0, 3, depth), nodes, 0, seen, points)
        assert seen == Counter(range(len(nodes)))  # every node once, numbered without a gap


def test_f3_a_large_forest_is_scored_and_weighed_without_loading_it(spark, grown, monkeypatch):
    monkeypatch.setattr(forest, "SUBTREE_ROWS", 50)
    monkeypatch.setattr(forest, "FILE_NODES", 300)  # scored in several pieces
    df = _frame(spark).withColumn("label", (F.col("label") > 0).cast("int"))
    results, models, _ = ml.train_and_compare(df, COLS, estimators={"Random Forest": _forest()}, key_cols=["k"])
    model = models["Random Forest"]
    f = model.stages[-1]
    imp = f.featureImportances.toArray()
    got = [(r.prediction, r.probability) for r in ml.score(model, df).orderBy("k").collect()]
    root = shared_dir(spark, f"f3-{uuid.uuid4().hex}")
    artifacts.save_models(spark, {"one": model, "two": model}, root)
    again = artifacts.load_models(spark, ["one"], root)["one"]
    assert [(r.prediction, r.probability) for r in ml.score(again, df).orderBy("k").collect()] == got
    for m in (f, again.stages[-1]):  # before, every node was an object of the driver
        assert isinstance(m, forest.ForestModel) and m._loaded is None
    plain = PipelineModel.load(f"{root}/one")  # the artefact is one of pyspark.ml
    assert isinstance(plain.stages[-1], RandomForestClassificationModel) and not isinstance(plain.stages[-1], forest.ForestModel)
    assert plain.uid == model.uid and [s.uid for s in plain.stages] == [s.uid for s in model.stages]
    assert np.allclose(plain.stages[-1].featureImportances.toArray(), imp, atol=1e-12)
    assert np.allclose(np.array([(r.prediction, r.probability) for r in ml.score(plain, df).orderBy("k").collect()]), np.array(got), atol=1e-12)
    assert results.first()["accuracy"] > 0.5 and not f.isSet("cacheNodeIds") and f.getMaxDepth() == 30
    assert f.toDebugString.split("\n", 1)[1] == plain.stages[-1].toDebugString.split("\n", 1)[1]  # loaded when asked for


def test_f1_f2_the_manifest_takes_the_root_as_a_uri_and_is_the_same_for_a_copy(spark, grown):
    df = _frame(spark).withColumn("label", (F.col("label") > 0).cast("int"))
    model = ml.train_and_compare(df, COLS, estimators={"Random Forest": _forest()}, key_cols=["k"])[1]["Random Forest"]
    root = shared_dir(spark, f"f1-{uuid.uuid4().hex}")
    root = root.removeprefix("file://")
    for name in ("one", "two"):  # at different times
        artifacts.save_models(spark, {name: model}, root)
    for base in (root, "file://" + root):  # the second found no path before
        got = {r.model: (r.sha256, r.n_files) for r in artifacts.artifact_manifest(spark, base, ["one", "two", "none"]).collect()}
        assert got["one"] == got["two"] and len(got["one"][0]) == 64 and got["none"] == ("missing", 0)
        assert got["one"][1] == 6
        digest = got["one"]
    artifacts.save_models(spark, {"three": artifacts.load_model(f"{root}/one")}, root)
    again = {r.model: (r.sha256, r.n_files) for r in artifacts.artifact_manifest(spark, root, ["one", "three"]).collect()}
    assert again["one"] == digest and again["three"] == digest


def test_f1_f2_other_rules_and_small_tables_are_left_to_spark(spark, monkeypatch):
    df = _rows(spark)
    assert not isinstance(_forest().fit(df), forest.ForestModel)
    monkeypatch.setattr(forest, "TABLE_ROWS", 10)
    monkeypatch.setattr(forest, "DRIVER_NODES", 0)
    assert isinstance(_forest().fit(df), forest.ForestModel)
    for other in (_forest().setImpurity("entropy"), _forest().setMinInstancesPerNode(3), _forest().setSubsamplingRate(0.5), _forest().setFeatureSubsetStrategy("all")):
        assert not isinstance(other.fit(df), forest.ForestModel)
