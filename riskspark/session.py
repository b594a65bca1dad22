"""Session construction and cluster-shared scratch locations."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "riskspark",
                  extra: dict | None = None) -> SparkSession:
    """Session used by tests, bench and examples.

    On a cluster the caller's own session is used instead; these settings are what the
    operators assume: AQE on (coalescing + skew join), UTC session zone (timestamps at rest
    are TIMESTAMP_NTZ), UI off.
    """
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.driver.memory", os.environ.get("RISKSPARK_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, sub: str = "") -> str:
    """Directory on storage every executor can reach, for checkpoints and staged tables.

    Taken from ``spark.checkpoint.dir`` (the cluster names it). Only a local-mode session
    without that setting (tests) gets a fresh temporary directory; on a cluster a missing
    setting is an error, never a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="riskspark-ckpt-")
    spark.sparkContext.setCheckpointDir(base)
    if not sub:
        return base
    return base.rstrip("/") + "/" + sub


def at_once(spark: SparkSession, calls: list[Callable[[], object]]) -> list:
    """The results of ``calls`` in their order. Each runs in a driver thread of its own, so the small
    stages of one use the cores that the others leave idle. Only for calls that do not depend on each other."""
    run = inheritable_thread_target(spark)(lambda call: call())
    with ThreadPool(max(len(calls), 1)) as pool:
        return pool.map(run, calls, chunksize=1)
