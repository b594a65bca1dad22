"""Ranked lexical search (operator 12).

``build_index`` writes an inverted index of whole texts: segments of bounded size, each with the
length of its documents and one posting list (places and frequencies) for every term. ``search``
joins the posting lists with the terms asked for, deals whole segments to search groups of a bounded
number of terms, and ranks inside each group:

* documents stand in ascending doc_id order; each posting carries its integer impact, and a sparse
  table of the posting lists answers where the largest impact of any range is (range maximum);
* an interval of documents is bounded by the weighted sum of its terms' range maxima. Intervals are
  taken best bound first, a batch at a time; each is split at the document of the maximum weighted
  impact, which is scored exactly, and both halves get bounds of their own. An interval whose bound
  cannot beat the k-th score (or equals it with later documents only) is never opened.

All scores are 64-bit integers, so bounds are exact and nothing is lost. The best k of each group
meet in one window. Queries are broadcast in blocks of at most :data:`BLOCK_TERMS` terms; a larger
set takes more passes over the index. Corpus numbers (N, L, df) come from the whole index.

Defined results: null or empty texts have no terms, count for nothing and are never found; items
without terms, or whose terms are nowhere, give no rows; every row of a repeated item is ranked;
repeated documents are ranked each; equal scores go by doc_id, a null doc_id last; an empty table
gives no rows. Only the key and text columns are read, so other names do not matter.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .common import Staging, read_table, slices, small_batches, utf8, word_hashes, word_spans

TOP = 10
#: Share of a document's length in its m, in per cent.
LENGTH_SHARE = 75
#: Bytes of text in a segment, and terms (with repeats) in a search group.
SEGMENT_BYTES = 4_000_000
SLICE_BYTES = 1_000_000
GROUP_TERMS = 6_000_000
#: Query terms (with repeats) in one broadcast block.
BLOCK_TERMS = 500_000
#: Intervals opened at once, at most.
BATCH = 64

TERM_BYTES = np.ones(256, bool)
TERM_BYTES[0x00:0x30] = TERM_BYTES[0x3A:0x41] = TERM_BYTES[0x5B:0x61] = TERM_BYTES[0x7B:0x80] = False
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: term null: the segment's documents (places: doc_ids and which of them are null; tfs: lengths).
INDEX = "segment long, term string, places binary, tfs binary, nulls binary"
FOUND = "query long, doc_id long, score long"


# ---------------------------------------------------------------- index

class _Segment:
    """Postings of one segment while its texts arrive."""

    def __init__(self):
        self.ids, self.nulls, self.lengths, self.size = [], [], [], 0
        self.names: dict[int, bytes] = {}
        self.parts: list[tuple] = []

    def add(self, b: pa.RecordBatch) -> None:
        buf, offs = utf8(b.column(1))
        s, e, row = word_spans(buf, offs, TERM_BYTES)
        h = word_hashes(buf, s, e)
        base = len(self.ids)
        order = np.lexsort((row, h))
        g, r = h[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(g)))
        term = np.ones(len(at), bool)
        term[1:] = g[at][1:] != g[at][:-1]
        raw = buf.tobytes()
        for x, i in zip(g[at[term]].tolist(), order[at[term]].tolist()):
            if x not in self.names:
                self.names[x] = raw[s[i]:e[i]].lower()  # bytes: A-Z only
        self.parts.append((g[at], (r[at] + base).astype(np.int32), tf.astype(np.int32)))
        ids = b.column(0)
        self.nulls += ids.is_null().to_pylist()
        self.ids += ids.fill_null(0).to_pylist()
        self.lengths += np.bincount(row, minlength=b.num_rows).tolist()
        self.size += len(buf)

    def rows(self, segment: int) -> pa.RecordBatch:
        h, place, tf = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(h, kind="stable")
        h, place, tf = h[order], place[order], tf[order]
        cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
        terms: list = [None] + [self.names[x].decode() for x in h[cuts[:-1]].tolist()]
        places = [np.array(self.ids, np.int64).tobytes()] + [place[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
        tfs = [np.array(self.lengths, np.int64).tobytes()] + [tf[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
        nulls = [np.array(self.nulls, bool).tobytes()] + [None] * (len(terms) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([segment] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(places, pa.binary()),
             pa.array(tfs, pa.binary()), pa.array(nulls, pa.binary())], ["segment", "term", "places", "tfs", "nulls"])


def _index(batches):
    number = TaskContext.get().partitionId() << 32
    seg = _Segment()
    for b in slices(batches, "text", SLICE_BYTES):
        seg.add(b)
        if seg.size >= SEGMENT_BYTES:
            yield seg.rows(number)
            number, seg = number + 1, _Segment()
    if seg.ids:
        yield seg.rows(number)


class Index:
    """A written index: ``table`` (schema :data:`INDEX`), and N and L of the whole corpus."""

    def __init__(self, table: DataFrame):
        self.table = table
        totals = table.where(F.col("term").isNull()).select("tfs").mapInArrow(_totals, "n long, l long").agg(
            F.sum("n"), F.sum("l")).first()
        self.n_docs, self.n_terms = totals[0] or 0, totals[1] or 0


def _totals(batches):
    for b in batches:
        lengths = [np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int((x > 0).sum()) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())],
            ["n", "l"])


def build_index(spark: SparkSession, docs: DataFrame, stage: Staging | None = None) -> Index:
    """The inverted index of every whole text of ``docs`` (doc_id, text), written to the shared folder."""
    small_batches(spark)
    stage = stage or Staging(spark, "lexical")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return Index(stage.write(rows.mapInArrow(_index, INDEX), "index"))


# ---------------------------------------------------------------- range maxima

class Postings:
    """Posting lists of one group side by side, longest first, with one sparse table over them.

    ``key`` is list number x documents + place, ascending, so one binary search finds a document in
    any list. Level j of the table holds, for posting i, the place of the largest impact among
    postings i .. i + 2**j - 1 (the first of equals); only lists of that length have the level.
    """

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int):
        """``lists``: (ascending document places, impacts) for each term number."""
        order = sorted(range(len(lists)), key=lambda t: -len(lists[t][0]))
        sizes = np.array([len(lists[t][0]) for t in order], np.int64)
        self.slot = np.zeros(len(lists), np.int64)
        self.slot[order] = np.arange(len(order))
        self.n_docs = n_docs
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.place = np.concatenate([lists[t][0] for t in order]).astype(np.int64)
        self.impact = np.concatenate([lists[t][1] for t in order]).astype(np.int64)
        self.key = np.repeat(np.arange(len(order)), sizes) * n_docs + self.place
        levels = [np.arange(len(self.place), dtype=np.int32)]
        width = 1
        while len(sizes) and sizes[0] >= 2 * width:
            have = int(self.first[np.searchsorted(-sizes, -2 * width, side="right")])
            low = levels[-1][:have]
            high = np.concatenate([levels[-1][width:have], levels[-1][have - width:have]])
            levels.append(np.where(self.impact[high] > self.impact[low], high, low).astype(np.int32))
            width *= 2
        self.level_at = np.cumsum([0] + [len(x) for x in levels[:-1]])
        self.table = np.concatenate(levels)

    def highest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact of each posting range [lo, hi), which must not be empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        a = self.table[self.level_at[level] + lo]
        b = self.table[self.level_at[level] + hi - (np.int64(1) << level)]
        return np.where(self.impact[b] > self.impact[a], b, a)


def best_documents(post: Postings, terms: np.ndarray, weights: np.ndarray, k: int):
    """The k highest documents (places, scores; score above 0) of a query, equal scores by place.

    ``terms``: list numbers; ``weights``: their weights times their repeats in the query.
    """
    slot = post.slot[terms]
    base = slot * post.n_docs
    n = len(terms)

    def bounds(lo, hi):
        """Sum of range maxima of each interval, and the document of its largest weighted impact."""
        some = lo < hi
        at = np.zeros(lo.shape, np.int64)
        at[some] = post.highest(lo[some], hi[some])
        worth = np.where(some, post.impact[at] * weights[None, :], 0)
        top = worth.argmax(axis=1)
        return worth.sum(axis=1), post.place[at[np.arange(len(lo)), top]]

    lo, hi = post.first[slot][None, :], post.first[slot + 1][None, :]
    bound, split = bounds(lo, hi)
    begin = np.zeros(1, np.int64)  # the interval's first document
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    batch = 1
    while len(bound):
        floor, last = (scores[k - 1], places[k - 1]) if len(scores) == k else (0, -1)
        # Nothing in a closed interval can displace the k-th: lower, or equal and later.
        open_ = (bound > floor) | ((bound == floor) & (begin < last))
        if not open_.all():
            bound, split, begin, lo, hi = bound[open_], split[open_], begin[open_], lo[open_], hi[open_]
            if not len(bound):
                break
        if len(bound) > batch:
            take = np.argpartition(-bound, batch - 1)[:batch]
            rest = np.ones(len(bound), bool)
            rest[take] = False
        else:
            take, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
        d = split[take]
        at = np.searchsorted(post.key, base[None, :] + d[:, None])
        inside = at < hi[take]
        hit = inside.copy()
        hit[inside] = post.place[at[inside]] == np.broadcast_to(d[:, None], at.shape)[inside]
        mine = np.zeros(at.shape, np.int64)
        mine[hit] = post.impact[at[hit]]
        places = np.concatenate([places, d])
        scores = np.concatenate([scores, (mine * weights[None, :]).sum(axis=1)])
        best = np.lexsort((places, -scores))[:k]
        places, scores = places[best], scores[best]
        new_lo = np.concatenate([lo[take], at + hit])
        new_hi = np.concatenate([at, hi[take]])
        new_begin = np.concatenate([begin[take], d + 1])
        some = (new_lo < new_hi).any(axis=1)
        new_lo, new_hi, new_begin = new_lo[some], new_hi[some], new_begin[some]
        new_bound, new_split = bounds(new_lo, new_hi) if len(new_lo) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        lo, hi = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi])
        begin = np.concatenate([begin[rest], new_begin])
        bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])
        batch = min(BATCH, 2 * batch)
    good = scores > 0
    return places[good], scores[good]


# ---------------------------------------------------------------- search

def _searcher(sent, n_docs: int, n_terms: int, k: int):
    """Ranks the queries of a block inside one group of segments."""
    def run(table: pa.Table) -> pa.Table:
        queries, weight = sent.value  # {query: {term: repeats}}, {term: w}
        t = table.to_pydict()
        docs: dict[int, int] = {}
        ids, nulls, lengths = [], [], []
        for seg, term, p, f, z in zip(t["segment"], t["term"], t["places"], t["tfs"], t["nulls"]):
            if term is None:
                docs[seg] = sum(map(len, ids))
                ids.append(np.frombuffer(p, np.int64))
                lengths.append(np.frombuffer(f, np.int64))
                nulls.append(np.frombuffer(z, bool))
        out: list[tuple] = []
        if docs:
            ids, lengths, nulls = np.concatenate(ids), np.concatenate(lengths), np.concatenate(nulls)
            order = np.lexsort((ids, nulls))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            m = (100 - LENGTH_SHARE) + (LENGTH_SHARE * lengths * n_docs) // max(1, n_terms)
            gathered: dict[str, list] = {}
            for seg, term, p, f in zip(t["segment"], t["term"], t["places"], t["tfs"]):
                if term is not None:
                    at = np.frombuffer(p, np.int32).astype(np.int64) + docs[seg]
                    tf = np.frombuffer(f, np.int32).astype(np.int64)
                    gathered.setdefault(term, []).append((rank[at], (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])))
            number, lists = {}, []
            for term, parts in gathered.items():
                place, impact = (np.concatenate(x) for x in zip(*parts))
                by = np.argsort(place)
                number[term] = len(lists)
                lists.append((place[by], impact[by]))
            if lists:
                post = Postings(lists, len(ids))
                for q, terms in queries.items():
                    mine = [x for x in terms if x in number and weight[x] > 0]
                    if mine:
                        places, scores = best_documents(
                            post, np.array([number[x] for x in mine]), np.array([weight[x] * terms[x] for x in mine], np.int64), k)
                        out += [(q, None if nulls[order[a]] else int(ids[order[a]]), int(b)) for a, b in zip(places, scores)]
        return pa.table({"query": pa.array([x[0] for x in out], pa.int64()), "doc_id": pa.array([x[1] for x in out], pa.int64()),
                         "score": pa.array([x[2] for x in out], pa.int64())})
    return run


def search(spark: SparkSession, index: Index, queries: DataFrame, key: str = "item_id", k: int = TOP) -> DataFrame:
    """The k best documents of each row of ``queries`` (``key``, text): ``key``, rank, doc_id, score."""
    stage = Staging(spark, "search")
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = stage.write(queries.select(F.col(key).alias("item"), F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)).alias("terms"))
                       .withColumn("query", F.monotonically_increasing_id()), "queries")
    n_blocks = max(1, -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    asked = stage.write(rows.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(
        F.count(F.lit(1)).alias("repeats")), "asked")
    lists = index.table.where(F.col("term").isNotNull())
    known = broadcast_if_small(asked.select(F.col("term").alias("wanted")).distinct(), BLOCK_TERMS)
    lists = stage.write(lists.join(known, F.col("term") == F.col("wanted")).select(*index.table.columns), "lists")
    df = stage.write(lists.groupBy("term").agg(F.sum(F.octet_length("places") / F.lit(4)).cast("long").alias("df")), "df")
    n_groups = max(1, -(-index.n_terms // GROUP_TERMS))
    every = lists.unionByName(index.table.where(F.col("term").isNull())).withColumn(
        "group", F.pmod(F.xxhash64("segment"), F.lit(n_groups)))
    found = None
    for i in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == i)
        block = mine.join(df, "term").collect()  # at most about BLOCK_TERMS rows
        terms: dict[int, dict] = {}
        for r in block:
            terms.setdefault(r["query"], {})[r["term"]] = r["repeats"]
        weight = {r["term"]: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1))) for r in block}
        sent = spark.sparkContext.broadcast((terms, weight))
        part = every.groupBy("group").applyInArrow(_searcher(sent, index.n_docs, index.n_terms, k), FOUND)
        part = stage.write(part, f"found-{i}-{uuid.uuid4().hex[:6]}")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(rows.select("query", "item"), "query").select(F.col("item").alias(key), "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(spark, build_index(spark, read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
nl AS (SELECT CAST(count(*) AS BIGINT) AS all_n, CAST(sum(len(w)) AS BIGINT) AS all_l FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, unnest(w) AS t, len(w) AS n FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
b AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(
    CAST(floor(1000 * ln((2 * all_n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_n) // all_l)))) AS BIGINT) AS score
  FROM b JOIN df USING (t) JOIN tf USING (t), nl GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
