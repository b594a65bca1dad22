"""Substring deduplication (operator 11).

Every window of ``width`` consecutive words gets a Rabin-Karp hash (two polynomials over word
hashes, taken from running sums, so a window costs two subtractions and two products). The
windows are counted in Spark by ranges of the second hash; a window whose words start earlier
elsewhere, in a document of smaller doc_id or earlier in its own, is repeated. The repeated
windows of a document merge into maximal intervals of words, which are cut out.

One task first counts the windows of its own block of texts, so a passage that stands in a third
of all documents reaches its range once a block and not once a document. A range is dealt a
bounded number of windows: the number of ranges follows the size of the corpus. Windows are told
apart by 64 bits and the bits that choose the range.

Defined results: null and empty texts have no words; a text shorter than a window keeps all of
them; a null doc_id is the largest; rows of one doc_id are one document as far as "earlier" goes,
so a repeated row keeps what its twin keeps; an empty table gives no rows. Extra columns of the
input are not read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, exact_word_hashes, mix, read_table, slices, small_batches, utf8, word_spans

WIDTH = 20
#: Bytes of text whose windows one hash range gets (about 1.3 million windows).
RANGE_BYTES = 8_000_000
#: Windows that a task counts by itself before it sends them on.
BLOCK_WINDOWS = 1_000_000
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1_000_000
#: Order of a null doc_id.
LAST = 2**63 - 1

SPACE = np.ones(256, bool)
SPACE[0x20] = SPACE[0x09:0x0E] = False

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))

RANGES = "part int, hash binary, doc binary, start binary, known boolean"
PLACES = "bucket int, doc binary, start binary, hash binary"
FOUND = "doc long, start binary, hash binary"
KEPT = ("doc_id long, n_words long, n_removed long, intervals array<struct<first:long,past:long>>, kept string")


def _inverse(b: np.uint64) -> np.uint64:
    return np.uint64(pow(int(b), -1, 2**64))


def rabin_karp(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash mod 2**64 of every ``width`` consecutive values: differences of the running
    sum of ``w[i] * base**i``, shifted back by ``base**-i``."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.full(len(words), base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers, out=run[1:])
    back = np.full(n, _inverse(base), np.uint64)
    back[0] = 1
    return (run[width:] - run[:n]) * np.cumprod(back)


def windows(buf: np.ndarray, offs: np.ndarray, width: int):
    """Windows inside the rows of one slice: both hashes, row, start in the row's words."""
    s, e, row = word_spans(buf, offs, SPACE)
    w = exact_word_hashes(buf, s, e)
    n_words = np.bincount(row, minlength=len(offs) - 1)
    h1 = rabin_karp(w, width, _BASES[0])
    ok = np.flatnonzero(row[:len(h1)] == row[width - 1:]) if len(h1) else np.zeros(0, np.int64)
    first = np.cumsum(n_words) - n_words
    of = row[ok]
    return h1[ok], rabin_karp(mix(w), width, _BASES[1])[ok], of, ok - first[of], n_words


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which the shuffle's compression shortens."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _deltas(x: np.ndarray) -> np.ndarray:
    """First value, then the steps, with the sign in the lowest bit (mod 2**64)."""
    d = np.diff(x, prepend=np.int64(0))
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def _undeltas(z: np.ndarray) -> np.ndarray:
    return np.cumsum(((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).view(np.int64))


def _earliest_first(h: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Places by (hash, doc, start); for each whether an earlier one has its hash, and whether it
    equals the one before in all three (rows of one doc_id at one start are equally early)."""
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    several = np.zeros(len(h), bool)
    several[1:] |= equal
    several[:-1] |= equal
    at = np.flatnonzero(several)
    order[at] = order[at][np.lexsort((start[order[at]], doc[order[at]], h[order[at]]))]
    d, s = doc[order], start[order]
    new = np.concatenate([[True], ~equal])
    head = np.flatnonzero(new)
    lead = np.repeat(head, np.diff(np.append(head, len(h))))
    twin = np.zeros(len(h), bool)
    twin[1:] = equal & (d[1:] == d[:-1]) & (s[1:] == s[:-1])
    return order, (d != d[lead]) | (s != s[lead]), twin


def _by(part: np.ndarray):
    """Places of each value of ``part``, in order."""
    order = np.argsort(part, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]


def _send(part, h, doc, start, known: bool):
    return [(int(part[x[0]]), (_top(h[x]) if known else h[x]).tobytes(), _planes(_deltas(doc[x])),
             _planes(start[x].astype(np.uint32)), known) for x in _by(part)]


def _top(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _bucket(doc: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Where the repeated windows of a document are gathered (a very long one in several pieces)."""
    return (mix(doc.view(np.uint64) + (start >> 12).astype(np.uint64) * _BASES[0]) % np.uint64(n)).astype(np.int32)


def _batch(rows, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _block(parts: list, n_ranges: int):
    """Rows of one block: its distinct windows by range, and those that it knows to be repeated."""
    h1, h2, doc, start = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order, later, twin = _earliest_first(h1, doc, start)
    once, gone = order[~later & ~twin], order[later & ~twin]  # the earliest stands for its twins
    once.sort()  # back to the order of the texts: near documents, short steps
    gone.sort()
    where = (((mix(h2[once]) >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int32)
    rows = _send(where, h1[once], doc[once], start[once], False)
    if len(gone):  # dealt by place, not by hash: a hot window does not gather anywhere
        rows += _send(_bucket(doc[gone], start[gone], n_ranges), h1[gone], doc[gone], start[gone], True)
    return rows


def _scanner(width: int, n_ranges: int):
    def run(batches):
        parts, held = [], 0
        for b in slices(batches, "text", SLICE_BYTES):
            buf, offs = utf8(b.column(1))
            h1, h2, row, start, _ = windows(buf, offs, width)
            if not len(h1):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            parts.append((h1, h2, ids[row].astype(np.int64), start.astype(np.int32)))
            held += len(h1)
            if held >= BLOCK_WINDOWS:
                yield _batch(_block(parts, n_ranges), RANGES)
                parts, held = [], 0
            del h1, h2, row, start
        if parts:
            yield _batch(_block(parts, n_ranges), RANGES)
    return run


def _judge(n_ranges: int):
    """Repeated windows of one hash range, packed by the bucket of their document."""
    def run(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        rows = [(p, d, s, h) for p, h, d, s, known in zip(*t.values()) if known]
        fresh = [(np.frombuffer(h, np.uint64), _undeltas(_unplanes(d, np.uint64)), _unplanes(s, np.uint32).astype(np.int64))
                 for h, d, s, known in zip(t["hash"], t["doc"], t["start"], t["known"]) if not known]
        if fresh:
            h, d, s = (np.concatenate(x) for x in zip(*fresh))
            order, later, twin = _earliest_first(h, d, s)
            pick = np.sort(order[later & ~twin])
            h, d, s = h[pick], d[pick], s[pick]
            where = _bucket(d, s, n_ranges)
            rows += [(int(where[x[0]]), _planes(_deltas(d[x])), _planes(s[x].astype(np.uint32)), _top(h[x]).tobytes())
                     for x in _by(where)]
        return pa.Table.from_batches([_batch(rows, PLACES)])
    return run


def _gather(table: pa.Table) -> pa.Table:
    """One row for each document of a bucket."""
    t = table.to_pydict()
    d = np.concatenate([_undeltas(_unplanes(x, np.uint64)) for x in t["doc"]])
    s = np.concatenate([_unplanes(x, np.uint32) for x in t["start"]])
    h = np.concatenate([np.frombuffer(x, np.uint32) for x in t["hash"]])
    order = np.lexsort((h, s, d))
    h, d, s = h[order], d[order], s[order]
    new = np.ones(len(h), bool)  # a repeated row tells the same twice
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    h, d, s = h[new], d[new], s[new]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [len(d)]])
    return pa.Table.from_batches([_batch([(int(d[x]), s[x:y].tobytes(), h[x:y].tobytes())
                                          for x, y in zip(cuts[:-1], cuts[1:])], FOUND)])


def _cut(width: int):
    """Rows (doc_id, text, found) to what is kept of them."""
    def run(batches):
        span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        for b in slices(batches, "text", SLICE_BYTES):
            buf, offs = utf8(b.column(1))
            s, e, row = word_spans(buf, offs, SPACE)
            n_words = np.bincount(row, minlength=b.num_rows)
            first = np.cumsum(n_words) - n_words
            found = b.column(2).to_pylist()
            w = exact_word_hashes(buf, s, e) if any(found) else None
            removed, intervals, kept = [], [], []
            raw = buf.tobytes()
            for i in range(b.num_rows):
                lo, hi = int(first[i]), int(first[i] + n_words[i])
                cover = np.zeros(hi - lo + 1, np.int32)
                if found[i] and hi - lo >= width:
                    at = np.concatenate([np.frombuffer(x["start"], np.uint32) for x in found[i]]).astype(np.int64)
                    top = np.concatenate([np.frombuffer(x["hash"], np.uint32) for x in found[i]])
                    mine = (rabin_karp(w[lo:hi], width, _BASES[0]) >> np.uint64(32)).astype(np.uint32)
                    # Another row of this doc_id may hold other words at this start.
                    ok = at < len(mine)
                    ok[ok] = mine[at[ok]] == top[ok]
                    np.add.at(cover, at[ok], 1)
                    np.add.at(cover, at[ok] + width, -1)
                hit = np.cumsum(cover[:-1]) > 0
                edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                begin, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                intervals.append([{"first": int(x), "past": int(y)} for x, y in zip(begin, past)])
                removed.append(int(hit.sum()))
                # bytes.split() parts words at exactly the bytes that SPACE leaves out.
                stay = np.concatenate([[0], past]), np.concatenate([begin, [hi - lo]])
                words = [x for p, q in zip(*stay) if p < q for x in raw[s[lo + p]:e[lo + q - 1]].split()]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(3), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(intervals, span),
                 pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "intervals", "kept"])
    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, intervals (of word places, removed and
    maximal) and kept (the words that stay, joined by one space)."""
    small_batches(spark)
    stage = Staging(spark, "substring")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"),
                       F.col("doc_id").cast("long").alias("id"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-size // RANGE_BYTES))
    dealt = rows.select("doc", "text").mapInArrow(_scanner(width, n_ranges), RANGES)
    packed = stage.write(dealt.groupBy("part").applyInArrow(_judge(n_ranges), PLACES), "packed")
    del dealt
    stage.free()
    found = stage.write(packed.groupBy("bucket").applyInArrow(_gather, FOUND), "found")
    stage.drop("packed")
    stage.free()
    by = found.groupBy("doc").agg(F.collect_list(F.struct("start", "hash")).alias("found")) \
              .withColumnRenamed("doc", "of")
    joined = rows.join(by, F.col("doc") == F.col("of"), "left").select("doc", "text", "found", "id")
    return joined.mapInArrow(_cut(width), KEPT)


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 20 words that start earlier elsewhere."""
    out = remove_repeats(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g
        FROM (SELECT r, k, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
low AS (SELECT g, min((k, i)) AS first FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT r, i FROM win JOIN low USING (g) WHERE (k, i) > first),
hit AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM gone)),
cut AS (SELECT r, list(p) AS ps, count(*) AS n FROM hit GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word WHERE NOT EXISTS
           (SELECT 1 FROM hit WHERE hit.r = word.r AND hit.p = word.p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""
