"""Model artefacts: save / load (K7, S7) and a manifest of their content."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import ForestModel, as_json, open_forest
from ..session import at_once


def save_model(model: PipelineModel, path: str) -> None:
    """K7: Spark ML persistence (the scaler and assembler are stages of the pipeline). A forest that is a table
    is copied as one; the artefact has the same form either way."""
    if not any(isinstance(s, ForestModel) for s in model.stages):
        model.write().overwrite().save(path)
        return
    PipelineModel([]).write().overwrite().save(path)
    for at, stage in zip(_stage_paths(path, [s.uid for s in model.stages]), model.stages):
        stage.save_copy(at) if isinstance(stage, ForestModel) else stage.write().save(at)
    spark = SparkSession.active()
    said = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    text = as_json(said | {"uid": model.uid, "paramMap": {"stageUids": [s.uid for s in model.stages]}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> PipelineModel:
    """S7. A large forest is not read into the driver."""
    spark = SparkSession.active()
    said = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    uids = said["paramMap"].get("stageUids", [])
    paths = _stage_paths(path, uids)
    forests = {at: open_forest(spark, at) for u, at in zip(uids, paths) if u.startswith("RandomForestClassifier_")}
    if not any(isinstance(f, ForestModel) for f in forests.values()):
        return PipelineModel.load(path)
    loaded = PipelineModel([forests[at] if at in forests else DefaultParamsReader.loadParamsInstance(at, spark) for at in paths])
    loaded._resetUid(said["uid"])
    return loaded


def _stage_paths(path: str, uids: list[str]) -> list[str]:
    return [f"{path}/stages/{k:0{len(str(len(uids)))}d}_{u}" for k, u in enumerate(uids)]


def save_models(spark: SparkSession, models: dict[str, PipelineModel], root: str) -> None:
    """K7 for each model, below ``root`` under its key."""
    at_once(spark, [lambda k=k, m=m: save_model(m, f"{root}/{k}") for k, m in models.items()])


def load_models(spark: SparkSession, keys: list[str], root: str) -> dict[str, PipelineModel]:
    """S7 for each key below ``root``."""
    return dict(zip(keys, at_once(spark, [lambda k=k: load_model(f"{root}/{k}") for k in keys])))


#: What a save adds that is not the model: its time and the random part of object names.
_WHEN = r'\\?"timestamp\\?":\d+,?'
_NAME = r"_[0-9a-f]{12,32}"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _WHEN, ""), _NAME, "")


def artifact_manifest(spark: SparkSession, root: str, expected: list[str]) -> DataFrame:
    """SHA-256 of the *content* of each saved model under ``root``: of every stage's metadata
    (keys sorted, without save time and random object names) and of every decoded data row, so the
    same model saved twice has one digest and any changed number another. File names, part sizes
    and compression do not enter. Rows are hashed where they are read, and their hashes folded in two
    steps (by first digits, then together), so no task gathers a large model's rows. Expected models
    without files get ``missing``."""
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))  # listed files name a local folder as file:/
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    rel = F.regexp_replace(F.col("path"), r"^(file:/*(?=/))?" + re.escape(base) + "/", "")
    files = files.withColumn("rel", rel).withColumn("model", F.split("rel", "/").getItem(0))
    n_files = files.groupBy("model").agg(F.count(F.lit(1)).alias("n_files"))
    # Two directories a stage: the list is as long as the pipelines, whatever the models' sizes.
    dirs = files.select("model", F.regexp_replace("rel", "/[^/]*$", "").alias("dir")).distinct().collect()
    parts = []
    for r in sorted(dirs):
        path = f"{base}/{r['dir']}"
        if r["dir"].endswith("/metadata"):
            text = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
            row = F.to_json(F.parse_json(_plain(F.col("value"))))  # a VARIANT object keeps its keys sorted
        else:
            text = spark.read.parquet(path)
            row = F.to_json(F.struct(*text.columns))
            row = _plain(row) if '"string"' in text.schema.json() else row  # numbers hold no names
        place = _plain(F.lit(r["dir"].partition("/")[2]))  # the stage, not the name it is saved under
        parts.append(text.select(F.lit(r["model"]).alias("model"), F.sha2(F.concat_ws("\n", place, row), 256).alias("sha")))
    names = spark.createDataFrame([(m,) for m in expected], "model string")
    if not parts:
        return names.select("model", F.lit(base).alias("root"), F.lit("missing").alias("sha256"), F.lit(0).cast("long").alias("n_files"))
    folded = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    per_model = rows.groupBy("model", F.substring("sha", 1, 4).alias("first")).agg(folded("sha").alias("sha")) \
                    .groupBy("model").agg(folded("sha").alias("sha256"))
    return (names.join(per_model, "model", "left").join(n_files, "model", "left")
            .select("model", F.lit(base).alias("root"), F.coalesce("sha256", F.lit("missing")).alias("sha256"),
                    F.coalesce("n_files", F.lit(0)).alias("n_files")))
