"""Benchmark decontamination (operator 5).

Benchmark texts become distinct windows of ten consecutive normalised words (an item of fewer
words is one window of its own length). The windows' 64-bit hashes form a sorted set that is
broadcast; every document's own windows are looked up in it in one scan of the whole text, and a
hit counts only if its words are equal. A broadcast holds :data:`BLOCK_WINDOWS` windows at most;
a larger benchmark is taken in blocks, each with its own scan, whose hits are then united.

Defined results: null or empty texts have no words; a null item_id marks words but is not
listed; repeated items and repeated documents are judged like single ones; an empty benchmark
hits nothing.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (Staging, read_table, slices, small_batches, utf8, window_hashes, word_hashes, word_spans)

WINDOW = 10
#: Windows in one broadcast (about 30 MB of words and hashes).
BLOCK_WINDOWS = 200_000

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[0x00:0x30] = WORD_BYTES[0x3A:0x41] = WORD_BYTES[0x5B:0x61] = WORD_BYTES[0x7B:0x80] = False
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

HITS = ("doc_id long, h long, n_words long, n_hit long, hit_words array<struct<first:long,past:long>>, "
        "spans array<struct<first:long,past:long>>, items array<string>")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: words (joined by one space), k, items (ids as strings)."""
    def cut(batches):
        for b in batches:
            ids, words, ks = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = _WORD.findall((t or "").encode().lower())
                k = min(WINDOW, len(w))
                for j in range(len(w) - k + 1 if k else 0):
                    ids.append(i)
                    words.append(b" ".join(w[j:j + k]).decode())
                    ks.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(words, pa.string()), pa.array(ks, pa.int32())], ["item", "words", "k"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, words string, k int").groupBy("words", "k").agg(
        F.sort_array(F.collect_set("item")).alias("items"))


class WindowSet:
    """A sorted array of window hashes with the windows themselves, and a small first filter."""

    def __init__(self, rows):
        self.words = [r["words"].encode() for r in rows]
        self.items = [r["items"] for r in rows]
        ks = np.array([r["k"] for r in rows], np.int64)
        buf = np.frombuffer(b" ".join(self.words), np.uint8)
        offs = np.array([0, len(buf)], np.int64)
        s, e, _ = word_spans(buf, offs, WORD_BYTES)
        w = word_hashes(buf, s, e)
        at = np.cumsum(ks) - ks
        h = np.zeros(len(ks), np.uint64)
        for k in np.unique(ks):
            pick = np.flatnonzero(ks == k)
            h[pick] = window_hashes(w, int(k))[at[pick]]
        self.lengths = sorted(set(ks.tolist()))
        order = np.argsort(h, kind="stable")
        self.hashes, self.order = h[order], order
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(h >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray):
        """Positions in ``h`` that are in the set, and where their equals begin in the sorted array."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[maybe])
        ok = at < len(self.hashes)
        ok[ok] = self.hashes[at[ok]] == h[maybe[ok]]
        return maybe[ok], at[ok]

    def equal(self, at: int, words: bytes):
        """The window of the sorted place ``at`` (or of equals after it) with these very words."""
        h = self.hashes[at]
        while at < len(self.hashes) and self.hashes[at] == h:
            if self.words[self.order[at]] == words:
                return int(self.order[at])
            at += 1
        return None


def _runs(covered: np.ndarray):
    d = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def scan(batches, windows: WindowSet):
    """Every document with its hit words, spans and items (rows: doc_id, h, text)."""
    for b in slices(batches, "text"):
        buf, offs = utf8(b.column(2))
        s, e, row = word_spans(buf, offs, WORD_BYTES)
        w = word_hashes(buf, s, e)
        mark = np.zeros(len(w) + 1, np.int32)
        items: dict[int, set] = {}
        for k in windows.lengths:
            h = window_hashes(w, k)
            pos, at = windows.lookup(h)
            inside = row[pos] == row[pos + k - 1]
            for j, a in zip(pos[inside].tolist(), at[inside].tolist()):
                words = b" ".join([buf[x:y].tobytes().lower() for x, y in zip(s[j:j + k].tolist(), e[j:j + k].tolist())])
                found = windows.equal(a, words)
                if found is not None:
                    mark[j] += 1
                    mark[j + k] -= 1
                    items.setdefault(int(row[j]), set()).update(windows.items[found])
        covered = np.cumsum(mark[:-1]) > 0
        n = b.num_rows
        n_words = np.bincount(row, minlength=n)
        n_hit = np.bincount(row[covered], minlength=n)
        begin = np.cumsum(n_words) - n_words
        hit_words, spans = [[]] * n, [[]] * n
        for i in items:
            lo, hi = int(begin[i]), int(begin[i] + n_words[i])
            first, past = _runs(covered[lo:hi])
            hit_words[i] = [{"first": int(x), "past": int(y)} for x, y in zip(first, past)]
            raw = buf[offs[i]:offs[i + 1]]
            points = np.cumsum((raw & 0xC0) != 0x80)  # code points up to each byte
            at = lambda byte: int(points[byte - offs[i] - 1]) if byte > offs[i] else 0
            spans[i] = [{"first": at(int(s[lo + x])), "past": at(int(e[lo + y - 1]))} for x, y in zip(first, past)]
        span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array(hit_words, span), pa.array(spans, span),
             pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string()))],
            ["doc_id", "h", "n_words", "n_hit", "hit_words", "spans", "items"])


def _united(spans) -> list:
    out: list = []
    for x in sorted((s["first"], s["past"]) for s in spans):
        if out and x[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x[1]))
        else:
            out.append(x)
    return [{"first": a, "past": b} for a, b in out]


def _unite(batches):
    """Hits of several blocks (lists of span lists) as one row each."""
    for b in batches:
        t = b.to_pylist()
        words = [_united(x for part in r["hit_words"] for x in part) for r in t]
        spans = [_united(x for part in r["spans"] for x in part) for r in t]
        span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2),
             pa.array([sum(x["past"] - x["first"] for x in w) for w in words], pa.int64()), pa.array(words, span),
             pa.array(spans, span),
             pa.array([sorted({x for part in r["items"] for x in part}) for r in t], pa.list_(pa.string()))],
            ["doc_id", "h", "n_words", "n_hit", "hit_words", "spans", "items"])


def find_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, h (hash of the text), n_words, n_hit, hit_words, spans, items."""
    small_batches(spark)
    stage = Staging(spark, "decontam")
    windows = stage.write(benchmark_windows(benchmark), "windows")
    n = windows.count()
    n_blocks = max(1, -(-n // block))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    parts = []
    for i in range(n_blocks):
        mine = windows if n_blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == i)
        sent = spark.sparkContext.broadcast([r.asDict() for r in mine.collect()])
        parts.append(rows.mapInArrow(_scanner(sent, uuid.uuid4().hex), HITS))
    if n_blocks == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # A row of equal (doc_id, h) may stand more than once: its copies are counted and put back.
    by = every.groupBy("doc_id", "h").agg(
        F.first("n_words").alias("n_words"), F.collect_list("hit_words").alias("hit_words"),
        F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"),
        (F.count(F.lit(1)) / n_blocks).cast("int").alias("copies"))
    one = by.select("doc_id", "h", "n_words", "hit_words", "spans", "items").mapInArrow(_unite, HITS)
    again = by.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.explode(F.sequence(F.lit(1), "copies")).alias("i"))
    return one.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select(*one.columns)


def _scanner(sent, name: str):
    def run(batches):
        return scan(batches, _window_set(sent, name))
    return run


_SETS: dict = {}


def _window_set(sent, name: str) -> WindowSet:
    """The worker's set of a block (made once a process)."""
    if name not in _SETS:
        _SETS.clear()
        _SETS[name] = WindowSet(sent.value)
    return _SETS[name]


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Each input row as one column ``row``, whatever its columns are called, with its key (d, g)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.select("row", F.col("row.doc_id").cast("long").alias("d"),
                       F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("g"))


def _same_row():
    return F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h"))


def remove_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    bad = find_hits(spark, docs, benchmark).where(F.col("n_hit") > 0).select("doc_id", "h").distinct()
    return _whole_rows(docs).join(bad, _same_row(), "left_anti").select("row.*")


def remove_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, mark: str = "\n\n") -> DataFrame:
    """``docs`` with every hit span replaced by ``mark`` (no word, so texts beside it do not join)."""
    bad = find_hits(spark, docs, benchmark).where(F.col("n_hit") > 0).select("doc_id", "h", "spans").dropDuplicates(["doc_id", "h"])
    joined = _whole_rows(docs).join(bad, _same_row(), "left")
    text = F.col("row.text")
    kept = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["first"] - a["at"]).cast("int")),
                                       F.lit(mark)).alias("out"), s["past"].alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.col("spans").isNull(), text).otherwise(kept)
    return joined.select(*[(clean if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits against the whole benchmark."""
    hits = find_hits(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM di),
hit AS (SELECT DISTINCT r, dw.k, i, item FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
