"""Structured Streaming versions of the scoring service and the polled dashboards.

R1 score_stream: request files -> model choice -> pipeline transform -> failover sink.
R2 daily_kpis_stream: tumbling daily KPIs with a watermark (append = sealed days only).
R3 trend_stream: sliding 7-day mean (a time window replaces the row window, which a stream
   cannot have).

Event time at rest is TIMESTAMP_NTZ; watermarks need TIMESTAMP, so the wall clock is mapped
to the instant with the same UTC reading (no session-zone dependence) and window days come
back as DATE values.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import risk_band, risk_percent
from ..operators.ordered import ntz_micros
from ..operators.staged import Staged
from ..operators.validate import staged_requests
from ..schemas import HIGH_KPI_PERCENT
from ..session import shared_dir
from ..sources.sinks import append_history, append_with_fallback

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def history_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                   glob: str | None = None) -> DataFrame:
    """Score history H as a stream over the event files of a directory (same projection as
    the batch view); ``glob`` picks a table below ``path``, one file or a directory of part files."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if glob:
        path = f"{path.rstrip('/')}/{{{glob}}}"  # a pattern may name a file; a plain path must be a directory
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = r.parquet(path)
    return ev.select(
        F.col("event_id").alias("record_id"), F.timestamp_micros(ntz_micros(F.col("ts"))).alias("event_time"),
        F.col("event_type").alias("model_used"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("probability"))


def daily_kpis(h: DataFrame, delay: str = "1 day") -> DataFrame:
    """R2: per day total, per-band counts, strict > 60 count and mean probability."""
    p = F.col("probability")
    band = risk_band(p)
    return (h.withWatermark("event_time", delay)
            .groupBy(F.window("event_time", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(band == "Low").alias("low_n"), F.count_if(band == "Moderate").alias("moderate_n"),
                 F.count_if(band == "High").alias("high_n"),
                 F.count_if(risk_percent(p) > F.lit(HIGH_KPI_PERCENT)).alias("over_60_n"),
                 F.avg(p).alias("avg_probability"))
            .select(_utc_date(F.col("w.start")).cast("timestamp_ntz").alias("day"), "total", "low_n", "moderate_n",
                    "high_n", "over_60_n", "avg_probability"))


def trend(h: DataFrame, length: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sliding-window mean risk percent."""
    return (h.withWatermark("event_time", delay)
            .groupBy(F.window("event_time", length, slide).alias("w"))
            .agg(F.avg(risk_percent("probability")).alias("mean_risk_percent"), F.count(F.lit(1)).alias("n"))
            .select(_utc_date(F.col("w.start")).cast("timestamp_ntz").alias("window_start"),
                    _utc_date(F.col("w.end")).cast("timestamp_ntz").alias("window_end"), "mean_risk_percent", "n"))


def _utc_date(ts: Column) -> Column:
    """The UTC calendar day of an instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def run_to_table(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming frame to completion over the data available now (restartable from the
    checkpoint: a rerun with no new input adds nothing)."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_daily_kpis(spark: SparkSession, events_dir: str, glob: str | None = None,
                      out_root: str | None = None) -> DataFrame:
    """R2 end to end: stream the events, write sealed days, read the result table back."""
    root = out_root or shared_dir(spark, f"riskspark-stream-{uuid.uuid4().hex}")
    out, ckpt = f"{root}/daily_kpis", f"{root}/_checkpoint"
    run_to_table(daily_kpis(history_stream(spark, events_dir, glob=glob)), out, ckpt)
    return spark.read.parquet(out)


def upsert_days(path: str):
    """A ``foreachBatch`` writer of update-mode KPI rows: each row replaces its day's partition
    (``kpi_day``) of the table at ``path``. A day's row always holds the whole day so far, so a batch
    delivered again writes the same rows over themselves, and only touched days are rewritten."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("kpi_day", F.to_date("day")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("kpi_day").parquet(path))
    return handle


def stream_live_kpis(spark: SparkSession, events_dir: str, glob: str | None = None, out_root: str | None = None,
                     delay: str = "1 day", max_files_per_trigger: int | None = None) -> DataFrame:
    """R2 live: every day's KPIs so far, the open day too, as the dashboard's cards poll them. The
    stream runs in update mode over what is there and can be started again for new files; events
    later than the watermark are left out, as in :func:`stream_daily_kpis`."""
    root = out_root or shared_dir(spark, f"riskspark-live-{uuid.uuid4().hex}")
    out = f"{root}/live_kpis"
    kpis = daily_kpis(history_stream(spark, events_dir, max_files_per_trigger, glob), delay)
    (kpis.writeStream.foreachBatch(upsert_days(out)).outputMode("update")
     .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).drop("kpi_day")


def stream_trend(spark: SparkSession, events_dir: str, glob: str | None = None,
                 out_root: str | None = None) -> DataFrame:
    """R3 end to end: sealed sliding 7-day windows written to a table and read back."""
    root = out_root or shared_dir(spark, f"riskspark-trend-{uuid.uuid4().hex}")
    out, ckpt = f"{root}/trend", f"{root}/_checkpoint"
    run_to_table(trend(history_stream(spark, events_dir, glob=glob)), out, ckpt)
    return spark.read.parquet(out)


def score_stream(spark: SparkSession, requests_path: str, schema: T.StructType, models: dict[str, PipelineModel],
                 primary: dict, fallback: dict, checkpoint: str, model_col: str = "model",
                 default_model: str = "random_forest", feature_cols: list[str] | None = None,
                 rejected: dict | None = None, model_hashes: dict[str, str] | None = None, on_stored=None):
    """Each micro-batch is split by chosen model (P24), scored with that model's pipeline
    and written with failover (K3). The write goes to the batch's own ``batch_id=<id>``
    directory in overwrite mode and counts once its commit record stands, so a batch replayed after
    a failure does not duplicate rows (``sources.sinks.read_stored`` reads both sinks); the
    checkpoint makes restarts resume after the last committed batch.

    With ``feature_cols``, rows with a missing or non-numeric feature go to the sink ``rejected``
    unscored (P25). ``model_hashes`` stamps each row with its model's digest and ``on_stored``
    is told (batch id, name of the sink that took the batch) (P31)."""
    from ..operators.ml import score_by_model

    if feature_cols and rejected is None:
        raise ValueError("feature_cols needs a sink for rejected rows")
    allowed = list(models)
    hashes = F.create_map(*[F.lit(x) for kv in (model_hashes or {}).items() for x in kv]) if model_hashes else None

    stage = Staged(spark, "stream-requests") if feature_cols else None

    def handle(batch: DataFrame, batch_id: int) -> None:
        if feature_cols:  # parsed and converted once a batch; the next batch overwrites the table
            batch, bad = staged_requests(batch, feature_cols, stage)
            append_history(bad, **rejected, batch_id=batch_id)
        chosen = batch.withColumn("model_used", F.when(F.col(model_col).isin(*allowed), F.col(model_col))
                                  .otherwise(F.lit(default_model)))
        scored = score_by_model(models, chosen).withColumn("timestamp", F.localtimestamp())
        if hashes is not None:
            scored = scored.withColumn("model_hash", hashes[F.col("model_used")])
        sink = append_with_fallback(scored, primary, fallback, batch_id=batch_id)
        if on_stored:
            on_stored(batch_id, sink)

    stream = spark.readStream.schema(schema).json(requests_path)
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
