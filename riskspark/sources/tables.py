"""Table scans and the two canonical views over the provided tables.

H (score history) and L (labelled rows) are plain projections of a Parquet scan, so
Catalyst prunes columns and pushes filters into the scan of every query built on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: the score history derived from ``events``.

    record_id, timestamp, entity_id, model_used, probability (clipped to 1.0).
    """
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("record_id"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("entity_id"),
        F.col("event_type").alias("model_used"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("probability"),
    )


HISTORY_SQL = ("SELECT event_id AS record_id, ts AS timestamp, user_id AS entity_id, "
               "event_type AS model_used, "
               "least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS probability FROM events")

L_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def labelled_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: labelled rows derived from ``lineitem``; label = returned, score = quantity / 50."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[F.col(c).cast("double").alias(c) for c in L_FEATURES],
        F.when(F.col("l_returnflag") == F.lit("R"), F.lit(1)).otherwise(F.lit(0)).alias("label"),
        (F.col("l_quantity") / F.lit(50.0)).alias("score"),
    )


LABELLED_SQL = ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                "CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, "
                "CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, "
                "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, "
                "l_quantity / CAST(50 AS DOUBLE) AS score FROM lineitem")
