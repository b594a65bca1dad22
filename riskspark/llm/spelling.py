"""Spelling variant grouping (operator 13).

Words with their counts are sharded by length. Every length shard becomes blocked Bloom filters:
a word sets :data:`BITS` bits inside one 512-bit block. Each word then probes the edits that lead
to a word of its own length (a code point replaced by a larger one of the alphabet: every pair is
asked from one side) and to a word shorter by one (a code point deleted: an insertion seen from
the other side). Edits are never written out to be probed; their hashes come from running sums of
per-place hashes. Only edits that a filter takes for words are built and shuffled to an exact join
with the vocabulary, which removes the false positives. Every pair found counts for both its words.

What is broadcast has a bound: a round sends the filters of at most :data:`ROUND_WORDS` words
(:data:`WORD_BYTES` bytes each), taken by length and hash range, and the alphabet of those words;
a larger vocabulary takes more rounds over the words, whose positives are united. Filters are made
in Spark, one task for each range.

Roots follow the forms by doubling: a form has at least twice the count of its word, so a chain has
at most log2(largest count) steps and the rounds are the logarithm of that.

Defined results: null texts have no words; a null doc_id enters the checksum as an empty string;
repeated rows count each time; equal largest counts take the smaller word in code-point order; an
empty table gives no rows. Only doc_id and text are read, so other names do not matter.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, mix, read_table, small_batches

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Count of a form against that of its word.
RATIO = 2
#: Bits that a word sets in its block of 512, and bytes of filter a word.
BITS = 6
WORD_BYTES = 2
#: Words whose filters are broadcast at once, and words of one filter.
ROUND_WORDS = 16_000_000
FILTER_WORDS = 1_000_000
#: Distinct words that a task holds before it sends its counts on.
HELD_WORDS = 300_000
#: Edits that are hashed at once.
PROBE_CELLS = 1_000_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SEED = np.uint64(0xA24BAED4963EE407)
_STEP = np.uint64(0x9FB21C651E98DF25)


# ---------------------------------------------------------------- words

def planted(doc_id: str | None):
    """The contract's word of each run of one document: where 97 divides the checksum of
    ``<doc_id>:<run>``, one code point is left out."""
    begin = zlib.crc32(f"{doc_id or ''}:".encode())

    def word(run: str) -> str:
        h = zlib.crc32(run.encode(), begin)
        if h % 97:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return word


def _as_is(doc_id: str | None):
    return lambda run: run


def _counts(word_of):
    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                word = word_of(doc_id)
                for r, n in Counter(_RUN.findall(text)).items():
                    held[word(r.lower() if r.isascii() else r.translate(_LOWER))] += n
                if len(held) > HELD_WORDS:
                    yield _count_batch(held)
                    held = Counter()
        if held:
            yield _count_batch(held)
    return run


def _count_batch(held: Counter):
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, word_of=_as_is, least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """Distinct words of all texts with their counts n; ``word_of(doc_id)(run)`` names a run's word."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = rows.mapInArrow(_counts(word_of), "word string, n long").where(F.char_length("word") >= least_length)
    return held.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- hashes of words and of their edits

def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _place(letter: np.ndarray, at) -> np.ndarray:
    """Hash of a code point at a place of a word."""
    return mix(letter.astype(np.uint64) * _STEP + np.asarray(at).astype(np.uint64) * _SEED + _SEED)


def _finish(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + np.uint64(length * int(_STEP) % 2**64))


def word_hash(letters: np.ndarray) -> np.ndarray:
    length = letters.shape[1]
    return _finish(_place(letters, np.arange(length)).sum(axis=1, dtype=np.uint64), length)


def deletion_hashes(letters: np.ndarray) -> np.ndarray:
    """Hash of each word without its i-th code point (words x places)."""
    length = letters.shape[1]
    at = np.arange(length)
    here, moved = _place(letters, at), np.zeros(letters.shape, np.uint64)
    moved[:, 1:] = _place(letters[:, 1:], at[:-1])
    before = np.cumsum(here, axis=1) - here
    after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1)
    return _finish(before + after, length - 1)


def replacement_hashes(letters: np.ndarray, alphabet: np.ndarray, first: int, places: int) -> np.ndarray:
    """Hash of each word with the code point at each of ``places`` places from ``first`` on replaced
    by each of ``alphabet``."""
    length = letters.shape[1]
    at = np.arange(length)
    here = _place(letters, at)
    rest = (here.sum(axis=1, dtype=np.uint64)[:, None] - here)[:, first:first + places]
    return _finish(rest[:, :, None] + _place(alphabet[None, :], at[first:first + places, None])[None], length)


# ---------------------------------------------------------------- filters

def _seats(h: np.ndarray, n_blocks: int):
    """Block of a hash, and its bits inside (hashes x BITS)."""
    block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    g = mix(h ^ _SEED)
    bits = [((g >> np.uint64(9 * i)) & np.uint64(511)) for i in range(BITS)]
    return block.astype(np.int64), bits


def build_filter(h: np.ndarray, n_blocks: int) -> np.ndarray:
    out = np.zeros(n_blocks * 8, np.uint64)
    block, bits = _seats(h, n_blocks)
    for b in bits:
        np.bitwise_or.at(out, block * 8 + (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    return out


def in_filter(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` that the filter takes for words; later bits are asked of what is left only."""
    block, bits = _seats(h, len(table) // 8)
    left = np.arange(len(h))
    for b in bits:
        w = b[left]
        left = left[(table[block[left] * 8 + (w >> np.uint64(6)).astype(np.int64)] >> (w & np.uint64(63))) & np.uint64(1) != 0]
    return left


def _range_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((mix(h + _STEP) >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def _make_filter(table: pa.Table) -> pa.Table:
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
    n_blocks = max(1, -(-len(h) * WORD_BYTES // 64))
    return pa.table({"length": table.column("length")[:1], "piece": table.column("piece")[:1],
                     "filter": pa.array([build_filter(h, n_blocks).tobytes()], pa.binary())})


def _hashes(n_ranges: dict):
    """Words to their hashes, dealt by length and hash range; the code points met come along."""
    def run(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            rows = []
            for length, some in _by_length(words):
                letters = _letters([words[i] for i in some])
                h = word_hash(letters)
                piece = _range_of(h, n_ranges[length])
                for p in np.unique(piece).tolist():
                    mine = piece == p
                    rows.append((length, p, h[mine].tobytes(), np.unique(letters[mine]).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["length", "piece", "hashes", "letters"])
    return run


def _by_length(words: list[str]):
    lens = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lens).tolist():
        yield length, np.flatnonzero(lens == length).tolist()


class Filters:
    """The filters of one round: by length, then by hash range, with the round's alphabet."""

    def __init__(self, rows, n_ranges: dict, alphabet):
        self.n_ranges = n_ranges
        self.tables = {(r["length"], r["piece"]): np.frombuffer(r["filter"], np.uint64) for r in rows}
        self.lengths = {length for length, _ in self.tables}
        self.alphabet = np.array(sorted(alphabet), np.uint32)

    def find(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` (hashes of edits of ``length``) that may be words of this round."""
        if self.n_ranges.get(length, 1) == 1:
            table = self.tables.get((length, 0))
            return in_filter(table, h) if table is not None else np.zeros(0, np.int64)
        piece, out = _range_of(h, self.n_ranges[length]), []
        for p in np.unique(piece).tolist():
            if (length, p) in self.tables:
                mine = np.flatnonzero(piece == p)
                out.append(mine[in_filter(self.tables[length, p], h[mine])])
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def probe(words: list[str], filters: Filters):
    """Positive edits of ``words``: (word, edit) lists. An edit is shorter by one, or as long and
    larger at the one place that differs."""
    left, right = [], []
    for length, some in _by_length(words):
        size = len(filters.alphabet)
        step = max(1, min(len(some), PROBE_CELLS // (length * max(1, size))))
        for lo in range(0, len(some), step):
            mine = [words[i] for i in some[lo:lo + step]]
            letters = _letters(mine)
            if length - 1 in filters.lengths:
                # Of a run of equal code points only the first is left out: the edits are equal.
                h = deletion_hashes(letters)
                new = np.ones(letters.shape, bool)
                new[:, 1:] = letters[:, 1:] != letters[:, :-1]
                ask = np.flatnonzero(new.reshape(-1))
                for x in ask[filters.find(length - 1, h.reshape(-1)[ask])].tolist():
                    w, i = mine[x // length], x % length
                    left.append(w)
                    right.append(w[:i] + w[i + 1:])
            if length not in filters.lengths or not size:
                continue
            places = max(1, PROBE_CELLS // (len(mine) * size))  # a very long word is asked piece by piece
            for at in range(0, length, places):
                h = replacement_hashes(letters, filters.alphabet, at, places)
                larger = filters.alphabet[None, None, :] > letters[:, at:at + places, None]
                ask = np.flatnonzero(larger.reshape(-1))
                width = larger.shape[1]
                for x in ask[filters.find(length, h.reshape(-1)[ask])].tolist():
                    w, i = mine[x // (width * size)], at + x // size % width
                    left.append(w)
                    right.append(w[:i] + chr(filters.alphabet[x % size]) + w[i + 1:])
    return left, right


_FILTERS: dict = {}


def _prober(sent, name: str):
    def run(batches):
        if name not in _FILTERS:
            _FILTERS.clear()
            _FILTERS[name] = Filters(*sent.value)
        for b in batches:
            left, right = probe(b.column(0).to_pylist(), _FILTERS[name])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["word", "edit"])
    return run


def positives(spark: SparkSession, stage: Staging, words: DataFrame) -> DataFrame:
    """Edits of words that a filter takes for words, true or false: (word, edit)."""
    lengths = {r["length"]: r["n"] for r in words.groupBy(F.char_length("word").alias("length"))
               .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word length
    n_ranges = {length: -(-n // FILTER_WORDS) for length, n in lengths.items()}
    dealt = words.select("word").mapInArrow(_hashes(n_ranges), "length int, piece long, hashes binary, letters array<long>")
    made = stage.write(dealt.groupBy("length", "piece").applyInArrow(
        _make_filter, "length int, piece long, filter binary"), "filters")
    # Every length and range once: rounds of at most ROUND_WORDS words, whole filters.
    per_round = max(1, ROUND_WORDS // FILTER_WORDS)
    slots = [(length, p) for length in sorted(n_ranges) for p in range(n_ranges[length])]
    weight = {s: -(-lengths[s[0]] // n_ranges[s[0]]) / FILTER_WORDS for s in slots}
    rounds, room = [], 0.0
    for s in slots:
        if not rounds or room + weight[s] > per_round:
            rounds.append([])
            room = 0.0
        rounds[-1].append(s)
        room += weight[s]
    letters = dealt.select(F.explode("letters").alias("c")).distinct()
    found = None
    alphabet = [r["c"] for r in letters.collect()]  # at most the code points of the script class
    for k, mine in enumerate(rounds):
        want = made.join(F.broadcast(spark.createDataFrame(mine, "length int, piece long")), ["length", "piece"])
        sent = spark.sparkContext.broadcast(([r.asDict() for r in want.collect()], n_ranges, alphabet))
        part = words.select("word").mapInArrow(_prober(sent, uuid.uuid4().hex), "word string, edit string")
        part = stage.write(part, f"positives-{k}")
        found = part if found is None else found.unionByName(part)
    return found


# ---------------------------------------------------------------- variants and roots

def _roots(stage: Staging, forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling the links until none moves."""
    at = stage.write(forms.select("word", F.col("form").alias("root")), "roots-0")
    k = 0
    while True:
        k += 1
        ahead = at.select(F.col("word").alias("of"), F.col("root").alias("further"))
        moved = at.join(ahead, F.col("root") == F.col("of"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = stage.write(moved, f"roots-{k}")
        if k > 1:
            stage.drop(f"roots-{k - 1}")
        at = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            return at


def spelling_variants(spark: SparkSession, counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of words with counts (word, n): word, form, root, n, n_near, form_n."""
    stage = Staging(spark, "spelling")
    words = stage.write(counts.select("word", "n"), "words")
    if words.limit(1).count() == 0:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n",
                            F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    maybe = positives(spark, stage, words)
    # The exact join: an edit that is no word falls out; then each pair is seen from both sides.
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = maybe.join(known, F.col("edit") == F.col("other")).select("word", "other", "other_n")
    sides = pairs.join(words, "word").select(F.explode(F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = words.join(best, "word", "left")
    has = F.col("best").isNotNull() & (-F.col("best.less") >= F.lit(ratio) * F.col("n"))
    near = stage.write(near.select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(stage, near.where(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, form and root."""
    return spelling_variants(spark, word_counts(read_table(spark, sf_dir, "documents"), planted))


OP13_SQL = r"""
WITH RECURSIVE byte AS (SELECT CAST(range AS BIGINT) AS b FROM range(256)),
tab(b, r, k) AS (SELECT b, b, 0 FROM byte UNION ALL
  SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM tab WHERE k < 8),
t0 AS (SELECT b, r FROM tab WHERE k = 8),
run AS (SELECT doc_id, w, count(*) AS c FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) GROUP BY ALL),
msg AS (SELECT row_number() OVER () AS id, w, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM run),
far AS (SELECT max(len(x)) // 2 AS n FROM msg),
step(k, b, r) AS (SELECT 0, b, r FROM t0 UNION ALL
  SELECT k + 1, s.b, xor(s.r >> 8, t0.r) FROM step s JOIN t0 ON t0.b = s.r & 255 WHERE k < (SELECT n FROM far)),
zero(k, r) AS (SELECT 0, CAST(4294967295 AS BIGINT) UNION ALL
  SELECT k + 1, xor(z.r >> 8, t0.r) FROM zero z JOIN t0 ON t0.b = z.r & 255 WHERE k < (SELECT n FROM far)),
part AS (SELECT id, len(x) // 2 AS n, i, CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) AS b
         FROM (SELECT id, x, unnest(range(len(x) // 2)) AS i FROM msg)),
crc AS (SELECT id, xor(xor(bit_xor(step.r), any_value(zero.r)), 4294967295) AS h
        FROM part JOIN step ON step.k = part.n - 1 - part.i AND step.b = part.b JOIN zero ON zero.k = part.n GROUP BY id),
word AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % len(w) AS BIGINT)) || substr(w, CAST(h % len(w) AS BIGINT) + 2)
                ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n
         FROM msg JOIN crc USING (id) GROUP BY 1),
v AS (SELECT word, n FROM word WHERE len(word) >= 5 AND n >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short
        FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
pair AS (SELECT DISTINCT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.short = v.word
  UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.short = v.word),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY v.n DESC, encode(y)) AS y, max(v.n) AS m FROM pair JOIN v ON v.word = y GROUP BY x),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN y END AS form,
             CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.x = v.word),
up(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.tip WHERE f.form IS NOT NULL),
root AS (SELECT up.word, up.tip FROM up JOIN f ON f.word = up.tip WHERE f.form IS NULL)
SELECT f.word, f.form, root.tip AS root, f.n, f.n_near, f.form_n FROM f JOIN root ON root.word = f.word
"""
