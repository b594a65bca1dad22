"""N-gram Jaccard join by a token-group matrix (operator 1).

A text's set is its distinct 5-word shingles as 64-bit hashes; texts of equal sets are one *node*
(a 64-bit digest of the set). Two nodes link when 100 * intersection >= 75 * union.

1. *Groups.* Bands of bin minima of the sets bring similar nodes together; a node is checked, set
   against set, with the most central node of each band only (the one that meets most others over
   all its bands), so thousands of near copies cost a few checks each. The components of these links
   are the groups; a group's own pairs need no further check, since all its nodes are connected already.
2. *Matrix.* What is left are links between groups. The smallest hashes of each set (enough that
   two linked sets share a known number of them) are dealt by hash range, and tokens that only one
   group holds fall out. A node that shares too few tokens with other groups has no link and is
   done; that ends the search for all but a few.
3. *Bound and open.* For the nodes left, the matrix holds each group's token union. The rarest
   shared tokens give the candidate groups, a node's overlap with the union of each is counted, and only
   groups where the overlap is enough for a link are opened, block by block: a block's own union
   bounds again, and the sets of blocks that pass are compared. Of two groups, the one of fewer
   nodes asks the other.
4. *Components* of all links by smallest labels and pointer jumps, each round a written table.

No step drops, caps or samples: steps 1 and 3 only order the work, and 2 is a proven bound.
Tokens are pre-aggregated before they are dealt, so a shingle in a third of all texts sends one
entry per task to its range.

Defined results: null or empty texts have an empty set and are their own component; texts under
five words are one shingle; repeated rows are listed each; a null doc_id takes part, its component
is the smallest doc_id that is there, or null; an empty table gives no rows. Digests are 64 bits:
among n different sets the chance of any false equal is n * n / 2**65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (SEAT, Staging, mix, read_table, slices, small_batches, utf8, window_hashes, word_hashes,
                     word_spans)

SHINGLE = 5
#: A link: NUMBER * intersection >= SHARE * union.
NUMBER, SHARE = 100, 75
BINS, BANDS = 64, 16
#: Bytes of text that are made sets at once.
SLICE_BYTES = 1_000_000
#: Tokens a task holds before it deals them, tokens of one hash range, and of one dealt piece. A group is held
#: by an executor's JVM and a Python worker at once, a piece is one row of a shuffle: both stay small.
HELD, RANGE, PIECE = 1_000_000, 300_000, 10_000
#: Tokens of one block of an opened group, and of the nodes that ask it in one task.
BLOCK, ASKERS = 4_000, 200_000

NO_SPACE = np.ones(256, bool)
NO_SPACE[0x20] = NO_SPACE[0x09:0x0E] = False
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(58))


# ---------------------------------------------------------------- sets

def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    s, e, row = word_spans(buf, offs, NO_SPACE)
    w = word_hashes(buf, s, e)
    h = window_hashes(w, SHINGLE)
    count = np.bincount(row, minlength=len(offs) - 1)
    begin = np.cumsum(count) - count
    out = []
    for b, n in zip(begin.tolist(), count.tolist()):
        if n >= SHINGLE:
            x = np.sort(h[b:b + n - SHINGLE + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            out.append(window_hashes(w[b:b + n], n) if n else np.zeros(0, np.uint64))
    return out


def least_common(n):
    """Smallest intersection that a set of n may have with a linked one: 75 % of it, rounded up."""
    return -(-SHARE * n // NUMBER)


def shared_least(n):
    """Prefix tokens that two linked sets share at least, the smaller having n."""
    return 1 + 15 * n // 100


def prefix_size(n):
    return n - least_common(n) + shared_least(n)


def node_of(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def band_keys(x: np.ndarray) -> np.ndarray:
    """One key for each band of bin minima that has any."""
    at = np.searchsorted(x, _EDGES)
    end = np.append(at[1:], len(x))
    low = np.where(at < end, x[np.minimum(at, len(x) - 1)], np.uint64(0)).reshape(BANDS, -1)
    key = np.zeros(BANDS, np.uint64)
    for i in range(low.shape[1]):
        key += mix(low[:, i] + SEAT[i]) * SEAT[i + 20]
    key = mix(key + SEAT[40] * np.arange(1, BANDS + 1, dtype=np.uint64))
    return key[low.any(1)].view(np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, h: hash of the text, n, node, bands) of every row."""
    def run(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(*utf8(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([node_of(x) if len(x) else None for x in sets], pa.int64()),
                 pa.array([band_keys(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))],
                ["doc_id", "h", "n", "node", "bands"])

    return docs.mapInArrow(run, "doc_id long, h long, n long, node long, bands array<long>")


# ---------------------------------------------------------------- checks and components

def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; texts (node, text) hold every node of them."""
    def run(batches):
        for b in batches:
            t: dict = {}
            for node, col in ((0, 2), (1, 3)):
                at = [i for x, i in {x: i for i, x in enumerate(b.column(node).to_pylist())}.items() if x not in t]
                if at:
                    for part in slices([b.take(pa.array(at))], b.schema.names[col], SLICE_BYTES):
                        t.update(zip(part.column(node).to_pylist(), shingle_sets(*utf8(part.column(col)))))
            keep = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                common = len(np.intersect1d(t[x], t[y], assume_unique=True))
                keep.append(NUMBER * common >= SHARE * (len(t[x]) + len(t[y]) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(stage: Staging, links: DataFrame, name: str) -> DataFrame:
    """(node, label) of all linked nodes; label is the smallest node of the component."""
    both = stage.write(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = stage.write(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-0")
    i = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select(
            "node", F.least("label", "next").alias("label"))
        i += 1
        new = stage.write(jump, f"{name}-{i}")
        same = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        stage.drop(f"{name}-{i - 1}")
        labels = new
        if same:
            return labels


def texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text for each of ``nodes``."""
    one = sets.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("doc_id", "h")).alias("at"))
    one = one.select("node", F.col("at.doc_id").alias("d"), F.col("at.h").alias("g"))
    return docs.join(one, (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d"))).select(
        "node", "text").dropDuplicates(["node"])


# ---------------------------------------------------------------- the matrix of prefix tokens

def dealt_prefix_tokens(docs: DataFrame, n_ranges: int) -> DataFrame:
    """Prefix tokens by ``part``: a hash range, or from ``n_ranges`` on tokens that a task saw in several nodes.

    The latter need no grouping; they are spread by a hash of the task's partition and the piece. A row
    has at most :data:`PIECE` tokens.
    """
    shape = "part int, tokens binary, nodes binary, sizes binary, many binary"

    def deal(batches):
        held: dict = {}  # by node: the copies of a set are one
        size = serial = 0
        partition = TaskContext.get().partitionId()

        def dealt():
            nonlocal serial
            owners, lens = np.array(list(held), np.int64), np.array([n for n, _ in held.values()], np.int32)
            tokens = np.concatenate([p for _, p in held.values()])
            owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(p) for _, p in held.values()])
            held.clear()
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            many = np.diff(np.append(first, len(tokens))) > 1
            several = np.flatnonzero(np.repeat(many, np.diff(np.append(first, len(tokens)))))
            for i in range(0, len(several), PIECE):
                at = several[i:i + PIECE]
                spread = int(mix(np.array([(partition << 32) + serial + 1], np.uint64))[0] % np.uint64(n_ranges))
                yield n_ranges + spread, tokens[at], owners[owner[at]], lens[owner[at]], np.ones(len(at), bool)
                serial += 1
            place = (((tokens[first] >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(place, np.arange(n_ranges + 1))
            for r in range(n_ranges):
                for i in range(cut[r], cut[r + 1], PIECE):
                    to = min(i + PIECE, cut[r + 1])
                    f = first[i:to]
                    yield r, tokens[f], owners[owner[f]], lens[owner[f]], many[i:to]

        def rows():
            some, tokens = [], 0
            for piece in dealt():
                some.append((piece[0], *(x.tobytes() for x in piece[1:])))
                tokens += len(piece[1])
                if tokens >= PIECE:
                    yield batch(some)
                    some, tokens = [], 0
            if some:
                yield batch(some)

        def batch(some):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*some), (pa.int32(), *[pa.binary()] * 4))],
                ["part", "tokens", "nodes", "sizes", "many"])

        for b in slices(batches, "text", SLICE_BYTES):
            for x in shingle_sets(*utf8(b.column(0))):
                if len(x) and (node := node_of(x)) not in held:
                    held[node] = len(x), x[:prefix_size(len(x))].copy()
                    size += len(held[node][1])
            if size >= HELD:
                yield from rows()
                size = 0
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(deal, shape)


def shared_prefix_tokens(docs: DataFrame, n_ranges: int) -> DataFrame:
    """(token, node, n) of the prefix tokens that at least two nodes hold."""
    def shared(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]])
        tokens, nodes, sizes, many = read("tokens", np.uint64), read("nodes", np.int64), read("sizes", np.int32), read("many", bool)
        if table["part"][0].as_py() < n_ranges:
            order = np.lexsort((nodes, tokens))
            tokens, nodes, sizes, many = tokens[order], nodes[order], sizes[order], many[order]
            new = np.append(True, tokens[1:] != tokens[:-1])
            first = np.flatnonzero(new)
            other = np.append(False, nodes[1:] != nodes[:-1]) & ~new
            wanted = np.logical_or.reduceat(other | many, first)
            keep = np.repeat(wanted, np.diff(np.append(first, len(tokens)))) & ~many  # a task that saw several nodes has dealt them all already
            tokens, nodes, sizes = tokens[keep], nodes[keep], sizes[keep]
        return pa.table({"token": tokens.view(np.int64), "node": nodes, "n": sizes.astype(np.int64)})

    return dealt_prefix_tokens(docs, n_ranges).groupBy("part").applyInArrow(shared, "token long, node long, n long")


def _grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with the group ``g`` of its nodes (a node without links is its own group)."""
    return df.join(groups.withColumnRenamed("label", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))


def _between_groups(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` (token, node, g, ...) whose token is in more than one group."""
    spread = tokens.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
    return tokens.join(spread.select("token"), "token", "left_semi")


def open_groups(stage: Staging, tokens: DataFrame) -> DataFrame:
    """Pairs (a, b) of one-node groups to be checked, and the links found in opened groups.

    tokens (token, node, g, n) are whole sets.

    Of two linked sets of n <= m elements at least 75/175 * (n + m) are shared. With s tokens in
    other groups, a set of n can therefore only link to sets of at most ``cap`` = s * 175/75 - n;
    and the smaller set of a link shares at least 6/7 of itself, which shortens its prefix. Groups
    meet in a prefix token; the group of fewer nodes then asks the other.
    """
    need = F.ceil(F.col("n") * SHARE / NUMBER)
    need_small = F.ceil(F.col("n") * 2 * SHARE / (NUMBER + SHARE))
    for i in range(3):  # tokens that only one group holds bind nothing; nodes with too few others fall out
        shared = _between_groups(tokens)
        enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("s"), F.first("n").alias("n")).where(
            F.col("s") >= need).select("node", "s")
        tokens = stage.write(shared.join(enough, "node").select("token", "node", "g", "n", "s"), f"shared-{i}")
        if i < 2:
            tokens = tokens.drop("s")
    tokens = tokens.withColumn("cap", F.floor(F.col("s") * (NUMBER + SHARE) / SHARE) - F.col("n"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rare"))
    ranked = tokens.join(rarity, "token").withColumn(
        "at", F.row_number().over(Window.partitionBy("node").orderBy("rare", "token")))
    # tokens of one group come first in the order: n - s of the prefix are such
    prefix = stage.write(ranked.where(F.col("at") <= F.col("s") - need + 1), "prefix")
    small = (F.col("cap") >= F.col("n")) & (F.col("at") <= F.col("s") - need_small + 1)
    matrix = prefix.groupBy("token", "g").agg(
        F.max("cap").alias("most"), F.max("n").alias("largest"), F.min(F.when(small, F.col("n"))).alias("asks"))
    asked = matrix.where("asks is not null").select("token", "g", "asks")
    held = matrix.select("token", F.col("g").alias("other"), "most", "largest")
    met = asked.join(held, "token").where("g <> other and asks <= most and asks <= largest").select(
        F.least("g", "other").alias("g"), F.greatest("g", "other").alias("other")).distinct()
    # Of two groups that meet, the one of fewer nodes asks and the other is bounded and opened.
    nodes = tokens.select("node", "g", "n", "cap").distinct()
    size = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    met = met.join(size, "g").join(size.select(F.col("g").alias("other"), F.col("k").alias("ko")), "other")
    swap = F.col("ko") < F.col("k")
    candidates = met.select(F.when(swap, F.col("other")).otherwise(F.col("g")).alias("g"),
                            F.when(swap, F.col("g")).otherwise(F.col("other")).alias("other"),
                            (F.greatest("k", "ko") == 1).alias("single"))
    candidates = stage.write(candidates, "candidates")
    union = tokens.select("token", F.col("g").alias("other")).distinct()
    overlap = candidates.where("not single").join(tokens.select("g", "node", "token", "n", "cap"), "g").join(union, ["token", "other"]).groupBy(
        "node", "other").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("cap").alias("cap"))
    opened = stage.write(overlap.where(F.col("m") >= need).select("node", "other"), "opened")
    # A group of one node is its own union: two of them are checked at once.
    one, two = (nodes.select(F.col("node").alias(x), F.col("g").alias(g), F.col("n").alias(f"n{x}"), F.col("cap").alias(f"cap{x}"))
                for x, g in (("a", "g"), ("b", "other")))
    single = candidates.where("single").join(one, "g").join(two, "other").where(
        (F.lit(NUMBER) * F.least("na", "nb") >= F.lit(SHARE) * F.greatest("na", "nb"))
        & (F.col("na") <= F.col("capb")) & (F.col("nb") <= F.col("capa")))
    return single.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), linked_in_blocks(opened, tokens)


def linked_in_blocks(opened: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes and the groups of ``opened`` (node, other).

    An opened group is cut into blocks of about :data:`BLOCK` tokens, each again bounded by its
    token union; only in blocks that pass are sets compared. The nodes that ask come in shares of
    about :data:`ASKERS` tokens, so neither side of a task grows with the group. A token of two
    groups is in ``tokens`` for both nodes, so intersections are those of the whole sets.
    """
    def run(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        sides = []
        for side in (t.filter(pa.array(asks)), t.filter(pa.array(~asks))):
            lists = [np.asarray(x.as_py(), np.int64) for x in side["t"]]
            sides.append((side["node"].to_numpy(), side["n"].to_numpy(), lists))
        (node, n, sets), (member, size, held) = sides
        a, b = [], []
        if len(node) and len(member):
            union, seat = np.unique(np.concatenate(held), return_inverse=True)
            begin = np.cumsum([0, *map(len, held)])[:-1]
            for x, k, own in zip(node, n, sets):
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                hit = np.zeros(len(union), np.int64)
                hit[at[union[at] == own]] = 1
                if hit.sum() * (NUMBER + SHARE) < SHARE * (k + size.min()):
                    continue
                common = np.add.reduceat(hit[seat], begin)
                near = member[NUMBER * common >= SHARE * (k + size - common)]
                a += np.minimum(x, near).tolist()
                b += np.maximum(x, near).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = tokens.groupBy("node").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.collect_list("token").alias("t"))
    weight = F.sum(F.size("t"))
    asking = opened.join(sets.drop("g"), "node").withColumnRenamed("other", "g")
    members = sets.join(opened.select(F.col("other").alias("g")).distinct(), "g", "left_semi")
    cuts = members.groupBy("g").agg(F.ceil(weight / BLOCK).alias("blocks")).join(
        asking.groupBy("g").agg(F.ceil(weight / ASKERS).alias("shares")), "g")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = asking.join(cuts, "g").select("g", every("blocks").alias("block"), own("shares").alias("share"), "node", "n", "t",
                                         F.lit(True).alias("asks"))
    rows = rows.unionByName(members.join(cuts, "g").select("g", own("blocks").alias("block"), every("shares").alias("share"),
                                                           "node", "n", "t", F.lit(False).alias("asks")))
    return rows.groupBy("g", "block", "share").applyInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------- the join

def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, c) of every row of ``docs`` (doc_id, text).

    ``c`` is the component's own label, null for an empty set; component_id is only its smallest doc_id.
    """
    small_batches(spark)
    stage = Staging(spark, "jaccard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    sets = stage.write(document_sets(docs), "sets")

    bands = sets.where("node is not null").select("node", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size"))
    met = stage.write(bands.join(shared.where("lo < hi").select("band", "size"), "band").distinct(), "met")
    # The original of many copies meets more of them, in more bands, than any copy does.
    central = met.groupBy("node").agg(F.sum("size").alias("central"))
    first = met.join(central, "node").groupBy("band").agg(F.max(F.struct("central", "node", "n")).alias("f")).select(
        "band", F.col("f.node").alias("b"), F.col("f.n").alias("nb"))
    near = met.join(first, "band").where(
        (F.col("node") != F.col("b")) & (F.lit(NUMBER) * F.least("n", "nb") >= F.lit(SHARE) * F.greatest("n", "nb")))
    pairs = stage.write(near.select(F.col("node").alias("a"), "b").distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links = stage.write(checked(pairs, stage.write(texts_of(docs, sets, nodes), "texts-1")), "links-1")
    stage.drop("texts-1", "pairs", "met")
    groups = components(stage, links, "groups")

    total = sets.agg(F.sum(prefix_size_sql("n"))).first()[0] or 0
    postings = stage.write(shared_prefix_tokens(docs, max(1, -(-int(total) // RANGE))), "postings")
    shared = _between_groups(_grouped(postings, groups)).groupBy("node", "g").agg(
        F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    least = F.floor((F.ceil(F.col("n") * SHARE / NUMBER)) * 15 / 100) + 1
    left = stage.write(shared.where(F.col("c") >= least).select("node", "g"), "left")
    stage.drop("postings")

    texts = stage.write(texts_of(docs, sets, left), "texts-2")
    whole = stage.write(whole_sets(texts.join(left, "node")), "whole")
    single, opened = open_groups(stage, whole)
    more = checked(single, texts).unionByName(opened)
    every = links.unionByName(stage.write(more, "links-2"))
    stage.drop("whole", "texts-2", "shared-0", "shared-1", "shared-2", "prefix", "candidates", "opened")

    labels = components(stage, every, "components")
    own = sets.select("doc_id", "h", "n", "node").join(labels, "node", "left").withColumn("c", F.coalesce("label", "node"))
    lowest = own.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low"))
    out = stage.write(own.join(lowest, "c", "left").select(
        "doc_id", "h", F.col("n").alias("n_shingles"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"), "c"), "result")
    stage.drop("sets", "links-1", "links-2")
    return out


def prefix_size_sql(n: str):
    least = F.ceil(F.col(n) * SHARE / NUMBER)
    return F.col(n) - least + 1 + F.floor(F.col(n) * 15 / 100)


def whole_sets(rows: DataFrame) -> DataFrame:
    """(token, node, g, n) for rows (node, text, g)."""
    def run(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(*utf8(b.column(1)))
            lens = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), lens)),
                 pa.array(np.repeat(b.column(2).to_numpy(), lens)), pa.array(np.repeat(lens, lens))], ["token", "node", "g", "n"])

    return rows.select("node", "text", "g").mapInArrow(run, "token long, node long, g long, n long")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return jaccard_components(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id (of equal rows, one), and every row of an
    empty set. The input row travels as one column, so its columns may have any names."""
    found = jaccard_components(spark, docs)
    one = found.where("c is not null").groupBy("c").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")).select("first.doc_id", "first.h")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("d"), F.xxhash64(text).alias("g"),
                       text.rlike(r"[^\x20\x09-\x0D]").alias("words"))  # any: the set is not empty
    kept = rows.where("words").join(one, (F.col("g") == F.col("h")) & F.col("d").eqNullSafe(F.col("doc_id")), "left_semi")
    again = Window.partitionBy("d", "g").orderBy(F.lit(0))
    return kept.withColumn("n", F.row_number().over(again)).where("n = 1").select("row.*").unionByName(
        rows.where(~F.col("words")).select("row.*"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i, w FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM s),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r AS a, r AS b FROM w UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (r)
JOIN (SELECT t.a AS r, min(v.doc_id) AS c FROM t JOIN w v ON v.r = t.b GROUP BY 1) m ON m.r = w.r
"""
