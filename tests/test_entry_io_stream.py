import os
import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
from riskspark.session import shared_dir
from riskspark.sources import files, sinks
from riskspark.streaming import jobs

from .conftest import SF


def test_entry_smoke(spark):
    r = E.entry(spark).collect()
    assert len(r) == 1 and r[0].total == 1000


def test_every_query_has_oracle_or_is_rows_only():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(s) >= 38


def test_training_csv_markers(spark, tmp_path):
    p = tmp_path / "heart.csv"
    p.write_text("61.0,1.0,3.0,131.0,244.0,0.0,1.0,141.0,0.0,0.7,2.0,?,6.0,2\n"
                 "50.0,0.0,2.0,120.0,200.0,0.0,0.0,150.0,1.0,1.0,1.0,0.0,?,0\n")
    df = files.read_training(spark, str(p)).collect()
    assert df[0].ca is None and df[1].thal is None and df[0].target == 2.0


def test_missing_json_is_empty(spark):
    from riskspark.schemas import SCORE_RECORD_SCHEMA
    assert files.read_history_json(spark, "/nonexistent/riskspark/x.json", SCORE_RECORD_SCHEMA).count() == 0


def test_failover_sink(spark):
    root = shared_dir(spark, f"t-{uuid.uuid4().hex}")
    df = spark.createDataFrame([(1, 0.5)], "record_id long, probability double")
    where = sinks.append_with_fallback(df, {"path": f"{root}/p", "fmt": "no_such_store"}, {"path": f"{root}/f"})
    assert where == "fallback" and spark.read.parquet(f"{root}/f").count() == 1


def test_stream_restart_adds_nothing(spark):
    root = shared_dir(spark, f"s-{uuid.uuid4().hex}")
    first = jobs.stream_daily_kpis(spark, SF, glob="events.parquet", out_root=root).count()
    again = jobs.stream_daily_kpis(spark, SF, glob="events.parquet", out_root=root).count()
    assert first > 0 and again == first
