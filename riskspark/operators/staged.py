"""Tables written to the cluster's shared folder: they pin a nondeterministic assignment, and what
reads them survives the loss of any executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


class Staged:
    """Parquet tables below one fresh folder of ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = shared_dir(spark, f"{tag}-{uuid.uuid4().hex[:12]}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
