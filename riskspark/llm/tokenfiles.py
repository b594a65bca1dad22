"""Token-id files with keyed access through a minimal perfect hash index (operator 4).

Files below one folder:

* ``shard-*.bin``: the raw ids of consecutive documents (little-endian, 2 bytes each if the
  vocabulary allows, else 4), then a footer: doc_ids (int64), their validity (uint8), offsets in
  ids (uint64, one more than documents), and a tail of 4 int64 (documents, ids, bytes an id, magic).
* ``index-*.mph``: for the keys of one hash bucket, a minimal perfect hash (levels of bit arrays;
  a key's slot is the rank of its bit) and, per slot, a 32-bit fingerprint, the shard, the place
  of the key's first document in it and the number of its documents.
* the table ``manifest``: shard, file, documents, ids, and ``base``, the ids of all shards before.

Documents are range-partitioned by doc_id, so shards and the documents in them ascend. Writers
name files by attempt and only files that a finished task reported reach the manifest, so tasks
may fail and run again at any time. Files are opened with pyarrow's file systems by URI.

Defined results: null text is the end id alone; null doc_ids come first and are one key; rows
that repeat a doc_id are all kept, ordered by a hash of their text; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staging, mix, read_table, slices, small_batches, text_column
from .tokens import encoder

END_ID = 2
MAGIC = 0x314D4B5453524B52
#: Ids a shard holds before the next is begun, and keys an index bucket is meant to hold.
SHARD_IDS, BUCKET_KEYS = 32_000_000, 100_000
#: Ids of neighbouring documents that are read at once.
READ_IDS = 1_000_000
#: Bits a key in each level of the perfect hash.
GAMMA = 2.0

ENTRY = "shard string, place long, doc_id long, first long, n_tokens long"


def open_uri(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(base: str) -> str:
    return "file://" + base[5:] if base.startswith("file:/") and not base.startswith("file://") else base


# ---------------------------------------------------------------- writing

class _Shard:
    def __init__(self, folder: str, itemsize: int):
        self.name = f"shard-{uuid.uuid4().hex}.bin"
        self.fs, path = open_uri(f"{folder}/{self.name}")
        self.out = self.fs.open_output_stream(path)
        self.itemsize, self.docs, self.offs = itemsize, [], [0]

    def add(self, doc, raw: bytes) -> tuple:
        self.out.write(raw)
        entry = (self.name, len(self.docs), doc, self.offs[-1], len(raw) // self.itemsize)
        self.docs.append(doc)
        self.offs.append(self.offs[-1] + len(raw) // self.itemsize)
        return entry

    def close(self) -> None:
        n = len(self.docs)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.offs, "<u8").tobytes())
        self.out.write(np.array([n, self.offs[-1], self.itemsize, MAGIC], "<i8").tobytes())
        self.out.close()


def write_shards(docs: DataFrame, folder: str, path: str, n_parts: int) -> DataFrame:
    """Encode and write; one row per document (see :data:`ENTRY`), shards in the order of their first key."""
    def run(batches):
        enc = encoder(path, False)
        end = np.array([END_ID], enc.dtype).tobytes()
        shard, rows = None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                ["shard", "place", "doc_id", "first", "n_tokens"])

        for b in slices(batches, "text"):
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                if shard is None:
                    shard = _Shard(folder, enc.dtype.itemsize)
                rows.append(shard.add(doc, raw + end))
                if shard.offs[-1] >= SHARD_IDS:
                    shard.close()
                    shard = None
            yield flush()
            rows = []
        if shard is not None:
            shard.close()

    keyed = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    h = F.xxhash64("text")
    return (keyed.withColumn("h", h).repartitionByRange(n_parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
            .select("doc_id", "text").mapInArrow(run, ENTRY))


# ---------------------------------------------------------------- minimal perfect hash

class PerfectHash:
    """Levels of bit arrays: a key sits in the first level where its bit is its alone."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.ranks = levels, ranks

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, ranks, left, done = [], [], keys, 0
        while len(left):
            size = max(64, int(GAMMA * len(left) + 63) // 64 * 64)
            bit = cls._bit(left, len(levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            levels.append(alone)
            ranks.append(done + np.cumsum(alone) - 1)
            done += int(alone.sum())
            left = left[~alone[bit]]
            if len(levels) > 200:
                raise ValueError("equal keys")
        return cls(levels, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key (any slot, or -1, for a key that was not built in)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            bit = self._bit(keys[todo], level, len(bits))
            here = bits[bit]
            out[todo[here]] = rank[bit[here]]
            todo = todo[~here]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n, 8)
        at, levels, ranks, done = 8 * (n + 1), [], [], 0
        for s in sizes.tolist():
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, s // 8, at)).astype(bool)
            levels.append(bits)
            ranks.append(done + np.cumsum(bits) - 1)
            done += int(bits.sum())
            at += s // 8
        return cls(levels, ranks), at


SLOT = np.dtype([("fp", "<u4"), ("count", "<u4"), ("shard", "<u4"), ("place", "<u8")])


def write_index(entries: DataFrame, folder: str, n_buckets: int) -> DataFrame:
    """Index files of (key, fp, shard_no, place, count); returns (bucket, file, keys)."""
    def build(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        keys = table["key"].to_numpy().view(np.uint64)
        mph = PerfectHash.build(keys)
        slots = np.zeros(len(keys), SLOT)
        at = mph.slots(keys)
        for name, col in (("fp", "fp"), ("count", "count"), ("shard", "shard_no"), ("place", "place")):
            slots[name][at] = table[col].to_numpy()
        name = f"index-{b}-{uuid.uuid4().hex}.mph"
        fs, path = open_uri(f"{folder}/{name}")
        with fs.open_output_stream(path) as out:
            out.write(mph.dump() + slots.tobytes())
        return pa.table({"bucket": pa.array([b], pa.int32()), "file": [name], "keys": pa.array([len(keys)], pa.int64())})

    return (entries.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int"))
            .groupBy("bucket").applyInArrow(build, "bucket int, file string, keys long"))


def _keyed(doc_id: str = "doc_id") -> list:
    """Two independent 64-bit hashes of a key: its place in the index, its fingerprint (32 bits)."""
    k = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return [F.xxhash64(k).alias("key"), F.xxhash64(k, F.lit("fingerprint")).bitwiseAND(F.lit(0xFFFFFFFF)).alias("fp")]


class TokenFiles:
    """A folder of token files: its tables ``manifest``, ``index`` and ``runs`` (the further shards of
    keys whose documents run on)."""

    def __init__(self, spark: SparkSession, folder: str, manifest: DataFrame, index: DataFrame, n_buckets: int, runs: DataFrame):
        self.spark, self.folder, self.manifest, self.index = spark, folder, manifest, index
        self.n_buckets, self.runs = n_buckets, runs

    @classmethod
    def write(cls, spark: SparkSession, docs: DataFrame, path: str) -> TokenFiles:
        small_batches(spark)
        stage = Staging(spark, "tokens")
        folder = _uri(stage.path("files"))
        fs, local = open_uri(folder)
        fs.create_dir(local, recursive=True)
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        entries = stage.write(write_shards(docs, folder, path, n_parts), "entries")
        # One row per shard; shards ascend by their first key, nulls first, then by their last.
        per = entries.groupBy("shard").agg(
            F.min_by("doc_id", "place").alias("head"), F.max_by("doc_id", "place").alias("last"),
            F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
        order = Window.orderBy(F.col("head").asc_nulls_first(), F.col("last").asc_nulls_first(), F.col("shard"))
        manifest = per.select(
            "shard", (F.row_number().over(order) - 1).alias("shard_no"), "docs", "ids",
            F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        manifest = stage.write(manifest, "manifest")
        placed = entries.join(manifest.select("shard", "shard_no"), "shard")
        parts = placed.groupBy("doc_id", "shard_no").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
        found = stage.write(parts.groupBy("doc_id").agg(
            F.min(F.struct("shard_no", "place")).alias("at"), F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("shards")), "found")
        # Keys whose documents run on into other shards: their part in each of these.
        several = found.where("shards > 1").select(F.col("doc_id").alias("d"), F.col("at.shard_no").alias("head"))
        runs = stage.write(parts.join(several, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("shard_no") > F.col("head")))
                           .select("doc_id", "shard_no", "place", "n"), "runs")
        keys = found.select(*_keyed(), F.col("at.shard_no").alias("shard_no"), F.col("at.place").alias("place"), "count")
        n_buckets = max(1, -(-entries.count() // BUCKET_KEYS))
        index = stage.write(write_index(keys, folder, n_buckets), "index")
        stage.drop("entries", "found")
        return cls(spark, folder, manifest, index, n_buckets, runs)

    def find(self, keys: DataFrame) -> DataFrame:
        """``doc_id`` of ``keys`` with shard_no, place and count from the index; unknown keys are left out."""
        folder, n = self.folder, self.n_buckets

        def look(table: pa.Table) -> pa.Table:
            fs, path = open_uri(f"{folder}/{table['file'][0].as_py()}")
            with fs.open_input_file(path) as f:
                raw = f.read()
            mph, at = PerfectHash.load(raw)
            slots = np.frombuffer(raw, SLOT, offset=at)
            slot = mph.slots(table["key"].to_numpy().view(np.uint64))
            ok = slot >= 0
            ok[ok] = slots["fp"][slot[ok]] == table["fp"].to_numpy()[ok]
            hit = slots[slot[ok]]
            return pa.table({"doc_id": table["doc_id"].filter(pa.array(ok)), "shard_no": hit["shard"].astype(np.int32),
                             "place": hit["place"].astype(np.int64), "count": hit["count"].astype(np.int64)})

        asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().select("doc_id", *_keyed())
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
        return asked.join(self.index.select("bucket", "file"), "bucket").groupBy("bucket").applyInArrow(
            look, "doc_id long, shard_no int, place long, count long")

    def read(self, keys: DataFrame, with_ids: bool = True) -> DataFrame:
        """Every document of ``keys``, read by place: doc_id, start, n_tokens, ids_crc32 and, unless they are
        left in the files' readers, ids (little-endian)."""
        folder = self.folder
        shards = self.manifest.select("shard", "shard_no", "base", "docs")
        found = self.find(keys).withColumnsRenamed({"shard_no": "at_shard"})
        # A key's documents may run on into the next shards: ask each of them for its part.
        first = shards.select(F.col("shard_no").alias("at_shard"), F.col("docs").alias("at_docs"))
        here = found.join(first, "at_shard").select(
            "doc_id", F.col("at_shard").alias("shard_no"), "place", F.least("count", F.col("at_docs") - F.col("place")).alias("n"),
            (F.col("place") + F.col("count") > F.col("at_docs")).alias("over"))
        runs = self.runs.withColumnRenamed("doc_id", "d")
        spill = here.where("over").select("doc_id").join(runs, F.col("doc_id").eqNullSafe(F.col("d"))).select(
            "doc_id", "shard_no", "place", "n")
        asks = here.drop("over").unionByName(spill).join(shards.select("shard", "shard_no", "base"), "shard_no")

        def fetch(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The asked documents of one shard; its ids are read in runs, not as a whole."""
            name = key[0].as_py()
            fs, path = open_uri(f"{folder}/{name}")
            with fs.open_input_file(path) as f:
                size = f.size()
                f.seek(size - 32)
                docs, ids, width, magic = np.frombuffer(f.read(32), "<i8").tolist()
                if magic != MAGIC:
                    raise ValueError(f"{name} is no token file")
                f.seek(size - 32 - 8 * (docs + 1) - docs - 8 * docs)
                own = np.frombuffer(f.read(8 * docs), "<i8")
                valid = np.frombuffer(f.read(docs), np.uint8)
                offs = np.frombuffer(f.read(8 * (docs + 1)), "<u8").astype(np.int64)
                for b in batches:
                    base = b.column(b.schema.get_field_index("base"))[0].as_py() if b.num_rows else 0
                    place = b.column(b.schema.get_field_index("place")).to_numpy()
                    n = b.column(b.schema.get_field_index("n")).to_numpy()
                    want = np.repeat(place, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    asked = np.repeat(np.arange(len(n)), n)
                    want_ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
                    cols: list[list] = [[], [], [], [], []]
                    order = np.argsort(want, kind="stable")
                    want, asked = want[order], asked[order]
                    # Neighbouring documents are read at once, up to READ_IDS ids.
                    cuts = np.flatnonzero(np.diff(want) != 1) + 1
                    for run in np.split(np.arange(len(want)), cuts):
                        lo = 0
                        while lo < len(run):
                            begin = int(offs[want[run[lo]]])
                            hi = max(lo + 1, int(np.searchsorted(offs[want[run] + 1], begin + READ_IDS, side="right")))
                            f.seek(begin * width)
                            part = np.frombuffer(f.read((int(offs[want[run[hi - 1]] + 1]) - begin) * width), f"<u{width}")
                            for r, who in zip(want[run[lo:hi]].tolist(), asked[run[lo:hi]].tolist()):
                                doc = int(own[r]) if valid[r] else None
                                if doc != want_ids[who]:
                                    continue  # a fingerprint met by chance: the key is not in the files
                                raw = part[offs[r] - begin:offs[r + 1] - begin]
                                for c, v in zip(cols, (doc, base + int(offs[r]), len(raw), zlib.crc32(raw.astype("<u4")),
                                                       raw.tobytes() if with_ids else b"")):
                                    c.append(v)
                            lo = hi
                    out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays(out if with_ids else out[:4], names if with_ids else names[:4])

        return asks.groupBy("shard").applyInArrow(
            fetch, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def byte_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back by key."""
    docs = read_table(spark, sf_dir, "documents")
    files = TokenFiles.write(spark, docs.select("doc_id", "text"), byte_bpe())
    return files.read(docs.select("doc_id"), with_ids=False)
