"""Shared pieces: table access, staged tables in the cluster's shared folder, Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import shared_dir

#: Rows of one Arrow batch sent to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to :data:`ARROW_ROWS` rows (never raises a smaller setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


class Staging:
    """Tables written below one fresh folder of ``spark.checkpoint.dir``.

    A table cuts lineage: what reads it survives the loss of any executor. ``drop`` frees the
    tables that later steps no longer read; whatever the returned DataFrame reads must stay.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = shared_dir(spark, f"{tag}-{uuid.uuid4().hex[:12]}")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def free(self) -> None:
        """Let go of the shuffle files of finished steps: Spark's cleaner removes those whose plans
        the driver has collected as garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def text_column(df: DataFrame, name: str = "text") -> DataFrame:
    """``df`` with ``name`` as a non-null string (null: empty)."""
    return df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("")))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one array, and the n + 1 offsets of its rows."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(offs[0]) if len(offs) else 0
    return buf[lo:int(offs[-1])], offs - lo


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of one slice stays near ``most`` bytes (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(name)).cast(pa.large_binary())
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_G = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _G.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash like a-z
_POS = _G.integers(1, 2**63, 1024, dtype=np.int64).astype(np.uint64) | np.uint64(1)
SEAT = _G.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def word_spans(buf: np.ndarray, offs: np.ndarray, allowed: np.ndarray):
    """Maximal runs of ``allowed`` bytes inside each row: starts, ends, row of each run."""
    m = allowed[buf]
    first = offs[:-1][offs[:-1] < offs[1:]]
    before = np.zeros(len(m), bool)
    before[1:] = m[:-1]
    before[first] = False
    starts = np.flatnonzero(m & ~before)
    after = np.zeros(len(m), bool)
    after[:-1] = m[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


#: Bytes of words that are hashed at once: eight-byte arrays of them are made.
HASHED = 200_000


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, A-Z taken as a-z."""
    lens = ends - starts
    done = np.cumsum(lens)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] - lens[lo] + HASHED, side="right")))
        some = lens[lo:hi]
        cum = np.cumsum(some) - some
        where = np.arange(int(some.sum())) - np.repeat(cum, some)
        x = _BYTE[buf[np.repeat(starts[lo:hi], some) + where]] * _POS[where & 1023]
        x ^= x >> np.uint64(29)
        out[lo:hi] = mix(np.add.reduceat(x, cum) + some.astype(np.uint64) * SEAT[63])
        lo = hi
    return out


_H = np.random.Generator(np.random.PCG64(11_020))
_EXACT = _H.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_PLACE = _H.integers(1, 2**63, 1024, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def exact_word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes as it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = (np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(first, lens).astype(np.int32)) & 1023
    x = _EXACT[buf[np.repeat(starts - first, lens) + np.arange(int(lens.sum()))]] * _PLACE[place]
    x ^= x >> np.uint64(29)
    return mix(np.add.reduceat(x, first) + lens.astype(np.uint64) * _EXACT[7])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (rows are not told apart here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, (SEAT[62:63] * np.uint64(k))[0], np.uint64)
    for i in range(k):
        h += mix(words[i:i + n] + SEAT[i]) * SEAT[i + 20]
    return mix(h)
