"""Packing into sequences by shortest-pack-first over the length histogram (operator 6).

Each text is encoded whole; its ids are cut into pieces of :data:`SEQUENCE` and one remainder.
The driver sees only the histogram of piece lengths (at most 2048 numbers). Lengths are placed
longest first: all pieces of a length go to the open packing pattern with the most room (the
shortest pack), or open new ones, and a pattern is split when it has more packs than pieces are
left, so only pattern counts move. Pieces then get a rank within their length (salted, so a
length shared by a third of all rows is ranked in parts), and the rank says which pack of which
pattern, and which place in it, is theirs.

Defined results: a null text is empty (one piece, the end id); null doc_id is a value like any
other; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .common import Staging, read_table, slices, small_batches, text_column
from .tokens import encoder

SEQUENCE = 2048
END_ID = 1
#: Ranks within a length are counted in parts: at least so many, and one for so many pieces.
PARTS, PART_PIECES = 64, 100_000
#: Rows of the table of part sizes that are broadcast at most.
SIZE_ROWS = 200_000

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def cut_pieces(docs: DataFrame, path: str, size: int = SEQUENCE, keep_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, ids: little-endian) of whole texts."""
    def run(batches):
        enc = encoder(path, True)
        end = np.array([END_ID], enc.dtype).tobytes()
        for b in slices(batches, "text"):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, enc.dtype)
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size]
                    for c, v in zip(cols, (doc, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids),
                                           piece.tobytes() if keep_ids else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(run, PIECES)


def pack_histogram(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count of packs, lengths in order) by shortest-pack-first, longest lengths first."""
    shut: list[tuple[int, tuple[int, ...]]] = []
    open_: list[tuple[int, int, int, tuple[int, ...]]] = []  # (-room, serial, count, lengths): most room first
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        moved = []
        while left and open_ and -open_[0][0] >= length:
            room, _, count, lengths = heapq.heappop(open_)
            used = min(left, count)
            if count > used:
                serial += 1
                heapq.heappush(open_, (room, serial, count - used, lengths))
            left -= used
            moved.append((room + length, used, (*lengths, length)))
            if -moved[-1][0] >= length:  # room for more of this length
                serial += 1
                heapq.heappush(open_, (moved[-1][0], serial, used, moved[-1][2]))
                moved.pop()
        if left:
            per = size // length
            full, rest = divmod(left, per)
            for packs, k in ((full, per), (1 if rest else 0, rest)):
                if packs:
                    moved.append((-(size - k * length), packs, (length,) * k))
        for room, used, lengths in moved:
            if room == 0:
                shut.append((used, lengths))
            else:
                serial += 1
                heapq.heappush(open_, (room, serial, used, lengths))
    merged: dict[tuple[int, ...], int] = {}
    for count, lengths in [*shut, *((c, x) for _, _, c, x in open_)]:
        merged[lengths] = merged.get(lengths, 0) + count
    return sorted(((c, x) for x, c in merged.items()), key=lambda p: (p[1], p[0]), reverse=True)


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of places, in rank order."""
    by: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            by.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in by.items()}


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with ``rank`` within their length: ranks in parts plus the sizes of the parts before."""
    n_parts = max(PARTS, -(-sum(histogram.values()) // PART_PIECES))
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_parts))
    slim = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", part.alias("part"))
    w = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = slim.withColumn("within", F.row_number().over(w) - 1)
    sizes = slim.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(
        "length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    before = broadcast_if_small(before, SIZE_ROWS, known_rows=len(histogram) * n_parts)
    return ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))


def place(ranked: DataFrame, table: dict) -> DataFrame:
    """Add sequence_id and offset by looking each rank up in the runs of its length."""
    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                first, base, offset = table[int(x)]
                pick = np.flatnonzero(length == x)
                run_ = np.searchsorted(first, rank[pick], side="right") - 1
                seq[pick] = base[run_] + rank[pick] - first[run_]
                off[pick] = offset[run_]
            t = t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from t.select(OUT).to_batches()

    OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return ranked.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         "rank").mapInArrow(run, ", ".join(f"{c} long" for c in OUT))


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = SEQUENCE, keep_ids: bool = True):
    """(places, pieces): where every piece goes, and the pieces with their ids (doc_id, start, ids_crc32 are shared)."""
    small_batches(spark)
    stage = Staging(spark, "packing")
    pieces = stage.write(cut_pieces(docs, path, size, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = place(_ranked(pieces, histogram), slot_table(pack_histogram(histogram, size)))
    return places, pieces


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens: one row per piece."""
    places, _ = pack(spark, read_table(spark, sf_dir, "documents"), word_bpe())
    return places
