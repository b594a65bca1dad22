"""Language identification by interpolated Kneser-Ney character models (operator 2).

Letters are lower-cased, every run of other characters is one space. The 4-grams of all training
texts are counted in Spark, and from all of them Spark makes, per language, the Kneser-Ney model of
orders 1 to 4 (discounts from counts of counts, continuation counts below the highest order) as
tables of log probabilities and back-off weights. The distinct 4-grams of the texts to be judged are
joined to these tables and their back-off is done; the result goes out in sorted hash arrays, in
rounds of a bounded number of grams. A text gets the language of the lowest cross-entropy per
character over its whole length. The score is that language's share under a temperature fitted on
:data:`CALIBRATION_ROWS` training rows; texts whose cross-entropy lies above what the language's
training rows show are flagged ``rejected``. Models and tables grow with the input; the driver holds
one round's grams.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows with a null
lang teach nothing; a null doc_id counts as held out; without any training row all texts are
``und``; repeated rows are judged alike.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, mix, read_table, slices, small_batches
from .toxicity import held_out

ORDER, DISCOUNT = 4, 0.75
CALIBRATION_ROWS = 1000
#: Grams broadcast in one round (8 bytes and 4 a language each), and bytes of text taken at once.
ROUND_GRAMS, SLICE_BYTES = 2_000_000, 2_000_000
#: Standard deviations above a language's mean cross-entropy at which a text is rejected.
REJECT = 4.0
PAD = ORDER - 1

_U64 = np.uint64
_letter = np.zeros(65536, bool)
_lower = np.arange(65536, dtype=np.uint16)
for _i in range(65536):
    _c = chr(_i)
    if 0xD800 <= _i < 0xE000:
        _letter[_i] = True  # halves of characters beyond 16 bits: taken as letters here
    elif _c.isalpha():
        _letter[_i] = True
        if len(_c.lower()) == 1 and ord(_c.lower()) < 65536:
            _lower[_i] = ord(_c.lower())
_lower[~_letter] = 32


def units_of(texts: list[str]):
    """Normalised 16-bit units of texts, each after PAD spaces, and where each text begins and ends."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    pad = b" \0" * PAD
    u = _lower[np.frombuffer(pad + pad.join(raw), "<u2")]
    lens = np.array([len(r) // 2 for r in raw], np.int64)
    begin = np.cumsum(lens + PAD) - lens
    text = np.zeros(len(u), bool)
    text[np.repeat(begin, lens) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)] = True
    space = u == 32
    keep = np.ones(len(u), bool)
    keep[1:] = ~(space[1:] & space[:-1]) | ~text[1:]  # runs of spaces inside a text are one
    place = np.cumsum(keep) - keep
    ends = begin + lens
    total = int(keep.sum())
    return u[keep], np.append(place, total)[begin], np.append(place, total)[ends]


def grams_at(u: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The units that end at the places ``at``, packed, the last one lowest."""
    g = u[at].astype(_U64)
    for i in range(1, order):
        g |= u[at - i].astype(_U64) << _U64(16 * i)
    return g


def _places(begin, end):
    lens = end - begin
    return np.repeat(begin, lens) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens), lens


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows (lang, text)."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(g, kind="stable")
            g, n = g[order], n[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            return g[first], np.add.reduceat(n, first)

        def rows():
            for lang, parts in held.items():
                g, n = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])

        for b in slices(batches, "text"):
            langs = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for lang in set(langs):
                u, begin, end = units_of([t for t, x in zip(texts, langs) if x == lang])
                at, _ = _places(begin, end)
                if not len(at):
                    continue
                g, n = np.unique(grams_at(u, at, ORDER), return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((g, n))
                size += len(g)
                if len(parts) > 1 and len(parts[-1][0]) * 2 > len(parts[0][0]):
                    held[lang] = [merged(parts)]
            if size > 4_000_000:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _masked(gram, units: int):
    """The last ``units`` units of a packed gram."""
    return gram.bitwiseAND(F.lit((1 << (16 * units)) - 1))


class Models:
    """Kneser-Ney models of all languages as tables in the shared folder.

    ``levels[k]`` holds (gram, seen: lang place and log probability of each language that saw it),
    ``weights[k]`` (context, seen: lang place and log back-off weight); ``langs`` names the places.
    Nothing of this is held by the driver but the languages, the temperature and their limits.
    """

    def __init__(self, langs: list[str], levels: dict[int, DataFrame], weights: dict[int, DataFrame], floor: float):
        self.langs, self.levels, self.weights, self.floor = langs, levels, weights, floor
        self.temperature, self.limit = 1.0, [float("inf")] * len(langs)


def kneser_ney(stage: Staging, counts: DataFrame) -> Models | None:
    """The models of all counted grams (lang, gram, n): no gram is left out.

    Below the highest order a gram counts the different grams that end in it. The discount of a
    language and order is n1 / (n1 + 2 n2) of its counts of counts (:data:`DISCOUNT` where one of
    them is 0). Every order's probabilities join those of the order below."""
    counts = stage.write(counts, "counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    names = counts.sparkSession.createDataFrame(list(enumerate(langs)), "l int, lang string")  # one row a language
    level = stage.write(counts.join(F.broadcast(names), "lang").select("l", "gram", "n"), f"count-{ORDER}")
    by_order = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        level = stage.write(level.select("l", _masked(F.col("gram"), k).alias("gram")).groupBy("l", "gram").agg(
            F.count(F.lit(1)).alias("n")), f"count-{k}")
        by_order[k] = level
    floor = -float(np.log(max(2, by_order[1].select("gram").distinct().count() + 1)))  # one unit more than was met
    levels, weights, below = {}, {}, None
    for k in range(1, ORDER + 1):
        c = by_order[k]
        spread = c.groupBy("l").agg(F.count_if(F.col("n") == 1).cast("double").alias("n1"), F.count_if(F.col("n") == 2).cast("double").alias("n2"))
        d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(DISCOUNT))
        c = c.join(F.broadcast(spread.select("l", d.alias("d"))), "l")  # one row a language
        if k == 1:
            ctx = c.groupBy("l").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.first("d").alias("d")) \
                   .withColumn("weight", F.col("d") * F.col("kinds") / F.col("total")).drop("kinds", "d")
            p = c.join(F.broadcast(ctx), "l").withColumn("low", F.exp(F.lit(floor)))
            ctx = ctx.select("l", F.lit(0).cast("long").alias("context"), "weight")
        else:
            head = F.shiftrightunsigned("gram", 16).alias("context")
            ctx = stage.write(c.groupBy("l", head).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.first("d").alias("d"))
                              .select("l", "context", "total", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight")), f"context-{k}")
            low = below.select("l", F.col("gram").alias("tail"), F.col("p").alias("low"))
            p = c.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("tail", _masked(F.col("gram"), k - 1)) \
                 .join(ctx, ["l", "context"]).join(low, ["l", "tail"])
        p = p.select("l", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("low")).alias("p"))
        below = stage.write(p, f"p-{k}")
        seen = lambda value: F.collect_list(F.struct("l", F.log(value).cast("float").alias("v"))).alias("seen")  # noqa: E731  an entry a language
        levels[k] = stage.write(below.groupBy("gram").agg(seen("p")), f"level-{k}")
        weights[k] = stage.write(ctx.groupBy("context").agg(seen("weight")), f"weight-{k}")
    stage.drop("counts")
    return Models(langs, levels, weights, floor)


def _dense(col, n: int, missing: float) -> np.ndarray:
    """Rows of (place, value) lists as a rows x n array."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    out = np.full((len(col), n), missing, np.float32)
    lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
    flat = col.flatten()
    out[np.repeat(np.arange(len(col)), lens), flat.field("l").to_numpy()] = flat.field("v").to_numpy(zero_copy_only=False)
    return out


def resolved(stage: Staging, models: Models, grams: DataFrame) -> DataFrame:
    """(gram, lp): of each highest-order gram the log probabilities in all languages, back-off done."""
    t = grams
    for k in range(ORDER, 0, -1):
        t = t.join(models.levels[k].select(F.col("gram").alias(f"g{k}"), F.col("seen").alias(f"p{k}")),
                   _masked(F.col("gram"), k) == F.col(f"g{k}") if k < 4 else F.col("gram") == F.col(f"g{k}"), "left").drop(f"g{k}")
        head = F.shiftrightunsigned("gram", 16) if k == ORDER else F.shiftrightunsigned(_masked(F.col("gram"), k), 16)
        t = t.join(models.weights[k].select(F.col("context").alias(f"c{k}"), F.col("seen").alias(f"b{k}")),
                   head == F.col(f"c{k}"), "left").drop(f"c{k}")
    n, floor = len(models.langs), models.floor

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index
            lp = np.full((b.num_rows, n), floor, np.float32)
            for k in range(1, ORDER + 1):
                own = _dense(b.column(at(f"p{k}")), n, np.nan)
                back = _dense(b.column(at(f"b{k}")), n, 0.0)
                lp = np.where(np.isnan(own), back + lp, own)
            yield pa.RecordBatch.from_arrays(
                [b.column(at("gram")), pa.array([r.tobytes() for r in lp.astype(np.float32)], pa.binary())], ["gram", "lp"])

    return t.mapInArrow(run, "gram long, lp binary")


class Lookup:
    """Log probabilities of one round's grams in sorted hash arrays."""

    def __init__(self, gram: np.ndarray, lp: np.ndarray):
        h = mix(gram)
        order = np.argsort(h)
        self.keys, self.lp = h[order], lp[order]

    def find(self, gram: np.ndarray):
        """Which of ``gram`` are in this round, and their rows."""
        h = mix(gram)
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        here = np.flatnonzero(self.keys[at] == h) if len(self.keys) else np.zeros(0, np.int64)
        return here, at[here]


def distinct_grams(docs: DataFrame) -> DataFrame:
    """(gram) of all highest-order grams of the column ``text``."""
    def run(batches):
        held: list = []
        for b in slices(batches, "text", SLICE_BYTES):
            u, begin, end = units_of([t or "" for t in b.column(0).to_pylist()])
            at, _ = _places(begin, end)
            held.append(np.unique(grams_at(u, at, ORDER)))
            if sum(map(len, held)) > 2_000_000:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held.pop().view(np.int64))], ["gram"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], ["gram"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long").distinct()


def _summed(sent, n: int, name: str):
    """Rows (doc_id, h, text) to their log probabilities over the grams of one round."""
    def run(batches):
        if name not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[name] = Lookup(*sent.value)
        look = _LOOKUPS[name]
        for b in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in b.column(2).to_pylist()]
            u, begin, end = units_of(texts)
            at, lens = _places(begin, end)
            total = np.zeros((len(texts), n))
            if len(at):
                g, inv = np.unique(grams_at(u, at, ORDER), return_inverse=True)  # each distinct gram once
                lp = np.zeros((len(g), n))
                here, row = look.find(g)
                lp[here] = look.lp[row]
                some = np.flatnonzero(lens)
                first = (np.cumsum(lens) - lens)[some]
                for i in range(n):
                    total[some, i] = np.add.reduceat(lp[inv, i], first)
            letters = [any(map(str.isalpha, t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lens, pa.int64()), pa.array(letters, pa.bool_()),
                 pa.array(total.tolist(), pa.list_(pa.float64()))], ["doc_id", "h", "units", "letters", "lp"])
    return run


_LOOKUPS: dict = {}


def entropies(spark: SparkSession, docs: DataFrame, models: Models) -> DataFrame:
    """Per row of (doc_id, text): doc_id, h (hash of the text), units, letters, ce (cross-entropy per unit
    in every language). A round broadcasts :data:`ROUND_GRAMS` resolved grams at most and adds what
    they contribute; with more grams in the texts the rounds are added up."""
    small_batches(spark)
    stage = Staging(spark, "entropies")
    n = len(models.langs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    known = stage.write(resolved(stage, models, distinct_grams(rows)), "known")
    n_rounds = max(1, -(-known.count() // ROUND_GRAMS))
    parts = []
    for i in range(n_rounds):
        mine = known if n_rounds == 1 else known.where(F.pmod(F.xxhash64("gram"), F.lit(n_rounds)) == i)
        t = mine.toArrow()
        lp = np.frombuffer(b"".join(t["lp"].to_pylist()), np.float32).reshape(-1, n)
        sent = spark.sparkContext.broadcast((t["gram"].to_numpy().view(_U64), lp))
        del t, lp
        parts.append(rows.mapInArrow(_summed(sent, n, uuid.uuid4().hex),
                                     "doc_id long, h long, units long, letters boolean, lp array<double>"))
    ce = F.transform("lp", lambda x: F.when(F.col("units") > 0, -x / F.col("units")).otherwise(F.lit(0.0))).alias("ce")
    if n_rounds == 1:
        return parts[0].select("doc_id", "h", "units", "letters", ce)
    # Equal rows get equal sums in every round: one of each is added up, then they are put back.
    every = None
    for i, p in enumerate(parts):
        p = p.groupBy("doc_id", "h").agg(F.first("units").alias("units"), F.first("letters").alias("letters"), F.first("lp").alias("lp"),
                                         F.count(F.lit(1)).cast("int").alias("copies")).withColumn("round", F.lit(i))
        every = p if every is None else every.unionByName(p)
    added = lambda c: F.aggregate(c, F.array_repeat(F.lit(0.0), n), lambda a, x: F.zip_with(a, x["lp"], lambda p, q: p + q))
    one = every.groupBy("doc_id", "h").agg(
        F.first("units").alias("units"), F.first("letters").alias("letters"), F.first("copies").alias("copies"),
        added(F.array_sort(F.collect_list(F.struct("round", "lp")))).alias("lp"))  # an entry a round
    return one.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc_id", "h", "units", "letters", ce)


def _calibrate(models: Models, ce: np.ndarray, y: np.ndarray) -> None:
    """Temperature with the least log loss, and the cross-entropy limit of each language."""
    best = None
    for t in np.geomspace(0.005, 1.0, 25):
        z = -ce / t
        z -= z.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))
        if best is None or loss < best:
            best, models.temperature = loss, float(t)
    for i in range(len(models.langs)):
        own = ce[y == i, i]
        if len(own) > 10:
            models.limit[i] = float(own.mean() + REJECT * own.std())


def fit(spark: SparkSession, rows: DataFrame) -> Models | None:
    """Models of all rows (doc_id, lang, text) with a lang, calibrated on :data:`CALIBRATION_ROWS` of
    them, whatever the length of their texts; None without any."""
    small_batches(spark)
    stage = Staging(spark, "language")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    models = kneser_ney(stage, count_grams(rows))
    if models is None:
        return None
    some = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").orderBy(
        F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(CALIBRATION_ROWS)
    some = stage.write(some.withColumn("doc_id", F.monotonically_increasing_id()), "calibration")  # a key of its own
    ce = entropies(spark, some, models).where("units > 0").join(some.select("doc_id", "lang"), "doc_id").select("lang", "ce").collect()
    if ce:
        _calibrate(models, np.array([r["ce"] for r in ce]), np.array([models.langs.index(r["lang"]) for r in ce]))
    return models


def identify(spark: SparkSession, docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred (``und`` without a letter), score, cross_entropy, rejected for (doc_id, text)."""
    if models is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("rejected"))
    langs = F.array(*[F.lit(x) for x in models.langs])
    limits = F.array(*[F.lit(x) for x in models.limit])
    low = F.array_min("ce")
    place = F.array_position("ce", low).cast("int")
    share = F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp(-(x - low) / F.lit(models.temperature)))
    out = entropies(spark, docs, models)
    return out.select(
        "doc_id", F.when(F.col("letters"), F.element_at(langs, place)).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(F.col("letters"), 1 / share).otherwise(F.lit(0.0)).alias("score"), low.alias("cross_entropy"),
        (F.col("letters") & (low > F.element_at(limits, place))).alias("rejected"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    models = fit(spark, docs.select("doc_id", "lang", "text").where(~held_out()))
    out = identify(spark, docs.select("doc_id", "text"), models)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
