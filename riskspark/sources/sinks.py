"""Sinks (K1-K6, K8): append-only, atomically committed writes."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small


def append_history(df: DataFrame, path: str, fmt: str = "parquet", options: dict | None = None,
                   ts_col: str = "timestamp", batch_id: int | str | None = None) -> None:
    """K1/K2: append new records only (O(new rows), no read-modify-write), partitioned by the
    score date so later scans prune by day.

    With ``batch_id`` (a streaming micro-batch) the rows go to ``path/batch_id=<id>`` in
    overwrite mode, so a batch replayed after a failure replaces its own output instead of
    appending duplicates; reading ``path`` discovers ``batch_id`` as a partition column."""
    out = df.withColumn("score_date", F.to_date(F.col(ts_col))) if ts_col in df.columns else df
    if batch_id is not None:
        out = out.drop("batch_id")
        path = f"{path.rstrip('/')}/batch_id={batch_id}"
    w = out.write.mode("append" if batch_id is None else "overwrite").format(fmt).options(**(options or {}))
    if "score_date" in out.columns:
        w = w.partitionBy("score_date")
    w.save(path)


class Stored(str):
    """Name of the sink that took a write (``primary`` / ``fallback``), with the write's id and, after
    a failover, why the primary did not take it."""

    write_id: str
    reason: str | None

    def __new__(cls, sink: str, write_id: str, reason: str | None = None):
        out = super().__new__(cls, sink)
        out.write_id, out.reason = write_id, reason
        return out


def _commit_file(spark: SparkSession, path: str, write_id: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.commits/{write_id}.json")
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str, write_id: str) -> None:
    """The record that makes the rows of one write visible to :func:`read_committed`."""
    p, fs = _commit_file(spark, path, write_id)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"write_id": write_id}).encode()))
    out.close()


def is_committed(spark: SparkSession, path: str, write_id: str) -> bool:
    p, fs = _commit_file(spark, path, write_id)
    return fs.exists(p)


def append_with_fallback(df: DataFrame, primary: dict, fallback: dict, batch_id: int | None = None,
                         commit=commit) -> Stored:
    """K3: write to the primary sink; if that fails, write the same rows to the fallback sink.

    The rows go to a directory of the write's own (``batch_id=<id>``) and count from the moment its
    commit record stands beside the sink. A primary that fails before or in its commit leaves no
    record, so :func:`read_stored` shows its rows once, from the fallback; if the record stands
    although the commit raised, the primary has them. With ``batch_id`` a batch delivered again
    replaces its own directory. Each sink is a dict of ``append_history`` arguments (path, fmt,
    options)."""
    spark = df.sparkSession
    write_id = uuid.uuid4().hex if batch_id is None else str(int(batch_id))

    def store(sink: dict) -> None:
        append_history(df, **sink, batch_id=write_id)
        commit(spark, sink["path"], write_id)

    try:
        store(primary)
        return Stored("primary", write_id)
    except Exception as e:  # whatever fails in the primary, the rows go to the fallback
        if is_committed(spark, primary["path"], write_id):
            return Stored("primary", write_id)
        reason = f"{type(e).__name__}: {e}"[:500]
        try:
            store(fallback)
        except Exception as second:
            raise RuntimeError(f"neither sink took write {write_id}; primary: {reason}") from second
        return Stored("fallback", write_id, reason)


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """(write_id) of the committed writes of a sink; none when it has no records."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.commits")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "write_id string")
    return spark.read.schema("write_id string").json(p.toString()).distinct()


def read_committed(spark: SparkSession, path: str, fmt: str = "parquet", without: DataFrame | None = None) -> DataFrame | None:
    """Rows of the committed writes of a sink (but those of ``without``), with ``batch_id`` as text;
    None when nothing was ever committed there. Only the committed directories are scanned."""
    ids = _commits(spark, path)
    if without is not None:
        ids = ids.join(without, "write_id", "left_anti")
    if not ids.limit(1).count():
        return None
    rows = spark.read.format(fmt).load(path)
    rows = rows.withColumn("batch_id", F.col("batch_id").cast("string"))
    return rows.join(broadcast_if_small(ids), rows["batch_id"] == ids["write_id"], "left_semi")


def read_stored(spark: SparkSession, primary: str, fallback: str) -> DataFrame | None:
    """Every committed row once, with ``source``: a write that both sinks committed (a batch that fell
    over and was delivered again) counts in the primary."""
    parts = [(read_committed(spark, primary), "primary"),
             (read_committed(spark, fallback, without=_commits(spark, primary)), "fallback")]
    parts = [df.withColumn("source", F.lit(name)) for df, name in parts if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def write_metrics(df: DataFrame, path: str) -> None:
    """K4: metrics rows as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_comparison(rows: list[tuple[str, float, float]], spark, path: str) -> None:
    """K5: the ``{model: {accuracy, roc_auc}}`` document (a handful of models)."""
    doc = {m: {"accuracy": a, "roc_auc": r} for m, a, r in rows}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1) \
         .write.mode("overwrite").text(path)


def write_confusion(df: DataFrame, path: str) -> None:
    """K6: confusion cells as Parquet."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


# Times keep their microseconds (the JSON writer's own format stops at milliseconds).
_JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def export_history(df: DataFrame, path: str) -> None:
    """K8: history as JSON Lines (one record per line, splittable)."""
    df.write.mode("overwrite").options(**_JSON_TIMES).json(path)


def history_as_json(df: DataFrame) -> DataFrame:
    """K8 as a column: each record serialised with ``to_json``."""
    return df.select(F.to_json(F.struct(*df.columns), _JSON_TIMES).alias("json"))
