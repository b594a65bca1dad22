"""File sources (S1-S6, S9): explicit schemas, no inference, splittable formats preferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COMPARISON_DDL, METRICS_SCHEMA, MISSING_MARKER, TRAINING_SCHEMA

_BAD = "_malformed"


def read_training(spark: SparkSession, path: str, schema: T.StructType = TRAINING_SCHEMA,
                  strict: bool = True) -> DataFrame:
    """S1 (+P1, P2 in the scan): headerless CSV with fixed names, ``?`` read as NULL, every
    column double. ``strict`` fails on a non-numeric cell (FAILFAST) instead of nulling it."""
    return (spark.read.schema(schema).option("header", False).option("nullValue", MISSING_MARKER)
            .option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path))


def _parsed_history(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """(raw, rec): each JSON text and its records as an array; NULL where it does not parse."""
    try:
        raw = spark.read.text(path, wholetext=multi_line)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        raw = spark.createDataFrame([], "value string")
    raw = raw.select(F.col("value").alias("raw")).where(F.trim("raw") != "")
    if multi_line:
        return raw.withColumn("rec", F.from_json("raw", T.ArrayType(schema), {"mode": "PERMISSIVE"}))
    whole = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rec = raw.withColumn("rec", F.from_json("raw", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    return rec.withColumn("rec", F.when(F.col(f"rec.{_BAD}").isNull(), F.array("rec")))


def read_history_json(spark: SparkSession, path: str, schema: T.StructType,
                      multi_line: bool = False) -> DataFrame:
    """History records from JSON (JSON Lines by default - splittable; ``multi_line`` for
    one JSON array per file). A missing path gives an empty frame, as the fallback file
    reader does; texts that do not parse are left to :func:`malformed_history_json`."""
    good = _parsed_history(spark, path, schema, multi_line).select(F.explode("rec").alias("r"))
    return good.select(*[F.col(f"r.`{c}`").alias(c) for c in schema.fieldNames()])


def malformed_history_json(spark: SparkSession, path: str, schema: T.StructType,
                           multi_line: bool = False) -> DataFrame:
    """S2 quarantine: the raw texts :func:`read_history_json` leaves out."""
    return _parsed_history(spark, path, schema, multi_line).where("rec is null").select("raw")


def read_history(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """The whole history table without the store key ``_id``; column pruning and
    filters of the caller reach the scan."""
    df = spark.read.format(fmt).options(**(options or {})).load(path)
    return df.drop("_id") if "_id" in df.columns else df


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Flat metrics; an absent metric reads as 0."""
    df = spark.read.schema(METRICS_SCHEMA).json(path)
    return df.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in METRICS_SCHEMA.fieldNames()])


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """``{model: {accuracy, roc_auc}}`` documents -> one row per model."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), COMPARISON_DDL)
    return (raw.select(F.explode(m).alias("model", "v"))
            .select("model", F.col("v.accuracy").alias("accuracy"), F.col("v.roc_auc").alias("roc_auc")))


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    """The stored confusion cells ``(actual, predicted, n)``."""
    return spark.read.parquet(path)
