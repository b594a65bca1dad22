"""Nearest neighbours by a hash-prefix forest (operator 10).

Every tree gives a vector a long string of bits (the signs of random projections). The index
holds blocks of vectors; for each tree of a block the strings lie in a sorted array beside the
order of their vectors, so a prefix is a range of the array. A query descends in every tree to
its longest matching prefix, then all trees ascend together, one bit at a time, until the ranges
hold enough ids other than the query's own, or the whole block; these are scored exactly. The best of every block meet in one group per
query, which keeps the nearest :data:`K`.

The query set is taken in chunks of a bounded size, each broadcast to one pass over the blocks:
no pair of vectors is ever a row, and nothing that grows with the table is broadcast.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts, and rows
without a vec_id, take no part; only vectors of the query's own length are compared; a vec_id is
listed once per query, with its best score; equal query rows are answered once; ties go to the
smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, read_table

K = 5
TREES, BITS, SEED = 48, 32, 7
#: Vectors of a block, and queries of a chunk.
BLOCK, CHUNK = 4096, 8192
#: Ids other than the query's own at which the ascent ends, as a share of the block's ids, and the least of them.
WANTED, LEAST = 0.75, 256

BLOCKS = "dim int, ids binary, vectors binary, norms binary, strings binary, places binary, repeats boolean"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, in double precision."""
    v = F.col(vec_col).cast("array<double>")
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def projections(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, TREES * BITS))


def bit_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One 32-bit string per vector and tree, first projection in the highest bit."""
    out = np.empty((TREES, len(vectors)), np.uint32)
    weight = (np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32))
    for t in range(TREES):
        out[t] = ((vectors @ planes[:, t * BITS:(t + 1) * BITS]) > 0) @ weight
    return out


def _vectors(batch: pa.RecordBatch):
    """Rows of a batch as matrices, one for each length."""
    ids, col = batch.column(0).to_numpy(), batch.column(1)
    offs = col.offsets.to_numpy()
    flat = col.values.to_numpy()
    dims = np.diff(offs)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), ids[at], flat[offs[at][:, None] + np.arange(d)]


def distinct_rows(ids: np.ndarray, v: np.ndarray):
    """The rows without those that repeat both id and vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, v
    rows = np.column_stack([ids.astype("<i8").view("<f8"), v.astype("<f8")]).view(f"V{8 * (v.shape[1] + 1)}")
    at = np.sort(np.unique(rows.ravel(), return_index=True)[1])
    return ids[at], v[at]


def build_blocks(vectors: DataFrame) -> DataFrame:
    """Rows of :data:`BLOCKS`: at most :data:`BLOCK` vectors each, with the trees' sorted arrays."""
    def run(batches):
        held: dict[int, list] = {}

        def block(dim, ids, v):
            ids, v = distinct_rows(ids, v)
            s = bit_strings(v, projections(dim))
            order = np.argsort(s, axis=1, kind="stable").astype(np.uint16)
            row = (dim, ids.astype("<i8").tobytes(), v.astype("<f8").tobytes(),
                   np.sqrt((v * v).sum(1)).astype("<f8").tobytes(),
                   np.take_along_axis(s, order.astype(np.int64), 1).tobytes(), order.tobytes(),
                   len(np.unique(ids)) < len(ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 5, pa.bool_()))],
                ["dim", "ids", "vectors", "norms", "strings", "places", "repeats"])

        for b in batches:
            for dim, ids, v in _vectors(b):
                held.setdefault(dim, []).append((ids, v))
                while sum(len(x) for x, _ in held[dim]) >= BLOCK:
                    ids, v = (np.concatenate(x) for x in zip(*held[dim]))
                    held[dim] = [(ids[BLOCK:], v[BLOCK:])]
                    yield block(dim, ids[:BLOCK], v[:BLOCK])
        for dim, parts in held.items():
            ids, v = (np.concatenate(x) for x in zip(*parts))
            if len(ids):
                yield block(dim, ids, v)

    return vectors.mapInArrow(run, BLOCKS)


def ascend(strings: np.ndarray, asked: np.ndarray, wanted: int, take) -> None:
    """Calls ``take(query, first, past)`` with the ranges of every tree, from the longest prefix up.

    A query ascends until ``take`` returns true; at the root its ranges are the whole block. Depths
    where the ranges of all trees sum to less than ``wanted`` are passed over.
    ``strings`` (trees x vectors) is sorted in each tree, ``asked`` is trees x queries.
    """
    trees, n = strings.shape
    q = asked.shape[1]
    longest = np.zeros(q, np.int64)  # longest prefix met in any tree
    for t in range(trees):
        at = np.searchsorted(strings[t], asked[t])
        for near in (np.clip(at - 1, 0, n - 1), np.clip(at, 0, n - 1)):
            differ = (strings[t][near] ^ asked[t]).astype(np.float64)
            longest = np.maximum(longest, BITS - np.ceil(np.log2(differ + 1)).astype(np.int64))
    climbing = np.arange(q)
    for depth in range(int(longest.max(initial=0)), 0, -1):
        now = climbing[longest[climbing] >= depth]
        if not len(now):
            continue
        free = np.uint32((1 << (BITS - depth)) - 1)
        lo, hi = np.empty((trees, len(now)), np.int64), np.empty((trees, len(now)), np.int64)
        for t in range(trees):
            a = asked[t, now]
            lo[t] = np.searchsorted(strings[t], a & ~free, side="left")
            hi[t] = np.searchsorted(strings[t], a | free, side="right")
        full = np.flatnonzero((hi - lo).sum(0) >= wanted)
        done = [i for i in full if take(now[i], lo[:, i], hi[:, i])]
        climbing = np.setdiff1d(climbing, now[done], assume_unique=True)
    for j in climbing:
        take(j, np.zeros(trees, np.int64), np.full(trees, n, np.int64))


def _nearest(score: np.ndarray, ids: np.ndarray, k: int, repeats: bool):
    if len(score) > k and not repeats:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))
    if repeats:
        _, at = np.unique(ids[order], return_index=True)
        order = order[np.sort(at)]
    return ids[order[:k]], score[order[:k]]


def search_blocks(blocks: DataFrame, sent, k: int, wanted: float) -> DataFrame:
    """Per block and query of the chunk ``sent`` = {dim: (query numbers, ids, vectors)}: the k nearest found."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                if row["dim"] not in sent.value:
                    continue
                number, qid, q = sent.value[row["dim"]]
                ids = np.frombuffer(row["ids"], "<i8")
                v = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
                norms = np.frombuffer(row["norms"], "<f8")
                strings = np.frombuffer(row["strings"], np.uint32).reshape(TREES, -1)
                places = np.frombuffer(row["places"], np.uint16).reshape(TREES, -1)
                asked = bit_strings(q, projections(row["dim"]))
                kinds, kind = np.unique(ids, return_inverse=True)
                enough = min(len(kinds), max(LEAST, k, int(wanted * len(kinds))))
                qn = np.sqrt((q * q).sum(1))
                cols: list[list] = [[], [], [], []]

                def take(j, first, past):
                    hit = np.zeros(len(ids), bool)
                    for t in range(TREES):
                        hit[places[t, first[t]:past[t]]] = True
                    whole = hit.all()
                    hit &= ids != qid[j]
                    c = np.flatnonzero(hit)
                    if not whole and (len(c) < enough or row["repeats"] and len(np.unique(kind[c])) < enough):
                        return False
                    got, score = _nearest((v[c] * q[j]).sum(1) / (norms[c] * qn[j]), ids[c], k, row["repeats"])
                    for col, x in zip(cols, ([int(number[j])] * len(got), [int(qid[j])] * len(got), got.tolist(), score.tolist())):
                        col += x
                    return True

                ascend(strings, asked, enough, take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                    ["number", "query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "number long, query_id long, vec_id long, score double")


def nearest(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = K, wanted: float = WANTED) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (vec_id, v) over ``index`` (vec_id, v)."""
    stage = Staging(spark, "forest")
    n = index.count()
    blocks = stage.write(build_blocks(index.repartition(max(1, -(-n // BLOCK)))), "blocks")
    queries = queries.dropDuplicates(["vec_id", "v"])
    n_chunks = max(1, -(-queries.count() // CHUNK))
    queries = stage.write(queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_chunks))), "queries")
    found = []
    for c in range(n_chunks):
        rows = queries.where(F.col("chunk") == c).select("vec_id", "v").toArrow().combine_chunks()
        chunk: dict = {}
        serial = 0
        for b in rows.to_batches():
            for dim, ids, v in _vectors(b):
                chunk.setdefault(dim, []).append((np.arange(serial, serial + len(ids)) + c * (1 << 32), ids, v))
                serial += len(ids)
        sent = spark.sparkContext.broadcast({d: tuple(map(np.concatenate, zip(*p))) for d, p in chunk.items()})
        found.append(stage.write(search_blocks(blocks, sent, k, wanted), f"found-{c}"))
        sent.destroy()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("number", "query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("number", "query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k).alias("n"))
    stage.drop("blocks", "queries")
    return best.select("query_id", F.posexplode("n").alias("pos", "n")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose vec_id is divisible by 50, against all vectors."""
    index = valid_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(spark, index, index.where(F.col("vec_id") % 50 == 0))
