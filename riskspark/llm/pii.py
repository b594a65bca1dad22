"""Personal data by bootstrapped contextual extraction (operator 9), in SQL functions only.

1. *Seeds.* Four fixed expressions find e-mail addresses, IP addresses, card and phone numbers;
   matches that fail their check (parts, Luhn, number of digits) are dropped.
2. *Candidates.* Every token with a digit or ``@`` that has the look of a kind (:data:`LOOKS`)
   is an instance; the one and the two words before it are its lexical patterns.
3. *Pattern-instance graph.* Edges (kind, pattern, instance) are made distinct, so copies of a
   passage count once. In each round a pattern scores the share of its instances held to be
   personal; a new instance scores the mean of its patterns' scores. Patterns with
   :data:`SUPPORT` known instances and a share of :data:`CONFIDENCE` are trusted, and instances
   that trusted patterns find join the known ones of the next round.
4. *Discovery.* Candidates behind a trusted pattern that no base span covers are added.

Base spans always stay. Defined results: null text is empty (no spans); null doc_id is a value
like any other; rows that repeat are judged one by one and alike; an empty table gives no rows.
Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import chunks, let, running, starts
from .common import Staging, read_table

KINDS = ["email", "ip", "card", "phone"]

# Possessive forms of the expressions: the same matches, in linear time and constant stack.
EXPR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: The look a token must have to be a candidate of a kind.
LOOKS = {
    "email": r"^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+$",
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:[:/][0-9]+)?|(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4})$",
    "card": r"^(?:[0-9]-?){12,19}$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[(+]?[0-9][0-9().-]*[-.()][0-9().-]*[0-9]$",
}
#: Known instances a trusted pattern has at least, the share of its instances they make up, rounds.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.9, 3

_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_SPANS = "array<struct<first:bigint,past:bigint,found:string,before:string>>"


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(found, r"[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["found"])).alias(kind)


def _step(between: Column, found: Column) -> Column:
    """A match with the length of the text before it and, of that, at least the last two words."""
    tail = F.right(between, F.lit(80))
    more = (F.length(between) > 80) & tail.rlike(r"\s$") & ~tail.rlike(r"\s\S+\s+\S+\s+$")
    before = F.when(more, F.regexp_extract(between, r"(?:\S+\s+)?\S+\s+$", 0)).otherwise(tail)
    return F.struct(F.length(between).cast("long").alias("gap"), F.lower(before).alias("before"), found.alias("found"))


def _placed(steps: Column, span) -> Column:
    """Spans of matches in order; ``span(first, s)`` makes one of the match that begins at ``first``."""
    return running(steps, lambda s: s["gap"] + F.length(s["found"]), lambda at, s: span(at + s["gap"], s), _SPANS)


def _span(first: Column, found: Column, before: Column) -> Column:
    return F.struct(first.alias("first"), (first + F.length(found)).alias("past"), found.alias("found"), before.alias("before"))


def _matches(text: Column, expr: str) -> Column:
    """All matches with the text between them: that gives their places."""
    return let(F.regexp_extract_all(text, F.lit(expr), F.lit(0)), lambda found: F.zip_with(
        F.slice(F.split(text, expr, -1), 1, F.size(found)), found, _step))


def spans_of(text: Column, expr: str, needs: str | None = None) -> Column:
    """Spans (first, past, found, before) of all matches."""
    out = _placed(_matches(text, expr), lambda first, s: _span(first, s["found"], s["before"]))
    worth = text.rlike(expr) if needs is None else text.contains(needs) & text.rlike(expr)
    return F.when(worth, out).otherwise(F.array().cast(_SPANS))


def _candidates(text: Column) -> Column:
    """Identifier-like tokens with the words before them."""
    def span(first, s):
        head = F.regexp_extract(s["found"], r"^[^0-9A-Za-z+(\[:]*", 0)
        body = F.regexp_extract(s["found"], r"^[^0-9A-Za-z+(\[:]*(.*?)[^0-9A-Za-z]*$", 1)
        return _span(first + F.length(head), body, s["before"])

    return F.when(text.rlike(_TOKEN), _placed(_matches(text, _TOKEN), span)).otherwise(F.array().cast(_SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """Columns doc_id, h (hash of the text), email, ip, card, phone and candidates, without the text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("h"), "text",
                 *[spans_of(F.col("text"), EXPR[k], NEEDS[k]).alias(k) for k in KINDS],
                 _candidates(F.col("text")).alias("candidates"))
    return d.select("doc_id", "h", *[_checked(k) for k in KINDS], "candidates")


def _uncovered() -> Column:
    """Candidates that no base span touches. Each chunk of candidates meets the spans of its own stretch."""
    meet = lambda s, first, past: (s["first"] < past) & (s["past"] > first)

    def free(chunk, spans):
        # candidates are in order: the chunk's stretch is from its first to its last
        near = F.filter(spans, lambda s: meet(s, chunk[0]["first"], F.element_at(chunk, -1)["past"]))
        return let(near, lambda mine: F.filter(chunk, lambda c: ~F.exists(mine, lambda s: meet(s, c["first"], c["past"]))))

    every = F.transform(F.concat(*KINDS), lambda s: F.struct(s["first"].alias("first"), s["past"].alias("past")))
    return let(every, lambda spans: F.flatten(F.transform(chunks(F.col("candidates")), lambda chunk: free(chunk, spans))))


def instances(base: DataFrame) -> DataFrame:
    """One row per instance, kind and pattern: doc_id, h, kind, first, past, instance, seed, pattern.

    Base spans are the seeds. Tokens that no base span touches are the candidates, once for each
    kind whose look they have.
    """
    looks = F.array_compact(F.array(*[F.when(F.col("c.found").rlike(LOOKS[k]), F.lit(k)) for k in KINDS]))
    rows = base.where(F.size("candidates") > 0).select("doc_id", "h", F.explode(_uncovered()).alias("c")).select(
        "doc_id", "h", "c", F.explode(looks).alias("kind"), F.lit(False).alias("seed"))
    for k in KINDS:
        rows = rows.unionByName(base.where(F.size(k) > 0).select(
            "doc_id", "h", F.explode(k).alias("c"), F.lit(k).alias("kind"), F.lit(True).alias("seed")))
    w1 = F.regexp_extract("c.before", r"(\S+)\s+$", 1)
    w2 = F.regexp_extract("c.before", r"(\S+)\s+\S+\s+$", 1)
    patterns = F.array_compact(F.array(F.when(w1 != "", w1), F.when(w2 != "", F.concat(w2, F.lit(" "), w1))))
    return rows.select("doc_id", "h", "kind", F.col("c.first").alias("first"), F.col("c.past").alias("past"),
                       F.lower("c.found").alias("instance"), "seed", F.explode(patterns).alias("pattern"))


def trusted_patterns(stage: Staging, found: DataFrame) -> DataFrame:
    """(kind, pattern) trusted after :data:`ROUNDS` rounds over the pattern-instance graph."""
    edges = stage.write(found.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    known = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(ROUNDS):
        scored = edges.join(known, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            F.avg("score").alias("share"), F.count_if(F.col("score") >= CONFIDENCE).alias("support"))
        patterns = scored.where((F.col("support") >= SUPPORT) & (F.col("share") >= CONFIDENCE))
        reach = edges.join(patterns, ["kind", "pattern"], "left").groupBy("kind", "instance").agg(
            F.max(F.col("seed").cast("double")).alias("sure"), F.avg(F.col("share")).alias("mean"))
        known = reach.select("kind", "instance", F.greatest("sure", F.coalesce("mean", F.lit(0.0))).alias("score"))
    return stage.write(patterns.select("kind", "pattern"), "patterns")


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h, the base spans of each kind, and ``more``: spans (kind, first, past) discovered."""
    stage = Staging(spark, "pii")
    base = stage.write(base_spans(docs), "base")
    found = stage.write(instances(base), "instances")
    good = trusted_patterns(stage, found)
    more = (found.where(~F.col("seed")).join(good, ["kind", "pattern"], "left_semi")
            .groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("kind", "first", "past"))).alias("more")))
    more = more.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "more")
    out = base.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return out.select("doc_id", "h", *KINDS, F.coalesce("more", F.array().cast(
        "array<struct<kind:string,first:bigint,past:bigint>>")).alias("more"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["past"])), ",")


def _with_kind(k: str) -> Column:
    return F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["first"].alias("first"), s["past"].alias("past")))


def _more_of(kind: str) -> Column:
    return F.filter("more", lambda s: s["kind"] == kind)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = find_pii(spark, read_table(spark, sf_dir, "documents"))
    every = [F.array_sort(F.concat(_with_kind(k), _more_of(k))) for k in KINDS]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.concat(*[_with_kind(k) for k in KINDS])), 256).alias("base_sha256"),
        _listed(F.concat(*every)).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows the text. A span
    that begins inside an earlier one goes with it. The input row travels as one column, so its
    columns may have any names."""
    found = find_pii(spark, docs)
    spans = F.array_sort(F.transform(F.concat(*[_with_kind(k) for k in KINDS], F.col("more")), lambda s: F.struct(
        s["first"].alias("first"), s["past"].alias("past"), s["kind"].alias("kind"))))
    hit = (found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), spans.alias("spans"))
           .where(F.size("spans") > 0).dropDuplicates(["d", "g"]))
    text = F.col("row.text")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("h", F.xxhash64(F.coalesce(text, F.lit(""))))
    rows = rows.join(hit, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    past = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: F.greatest(n, s["past"]))
    cut = lambda t, first, stop: F.substring(t, (first + 1).cast("int"), (stop - first).cast("int"))

    def fold(chunk, first):
        def step(part, a, s):  # places inside a chunk count from its start
            mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s["first"] >= a["at"], F.struct(
                F.concat(a["out"], cut(part, a["at"] - first, s["first"] - first), mark).alias("out"), s["past"].alias("at"))).otherwise(
                F.struct(a["out"].alias("out"), F.greatest(a["at"], s["past"]).alias("at")))

        start = F.struct(F.lit("").alias("out"), first.alias("at"))
        return let(cut(text, first, past(chunk)), lambda part: F.aggregate(
            chunk, start, lambda a, s: step(part, a, s), lambda a: a["out"]))

    pieces = let(chunks(F.col("spans")), lambda c: F.zip_with(c, starts(c, past, F.greatest), fold))
    clean = F.concat(F.array_join(pieces, ""), cut(text, past(F.col("spans")), F.length(text)))
    rows = rows.select("row", F.col("spans").isNotNull().alias("hit"), F.when(F.col("spans").isNotNull(), clean).alias("clean"))
    own = lambda c: F.col(f"row.`{c}`")
    change = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return rows.select(*[
        (F.when(F.col("hit"), change[c].cast(docs.schema[c].dataType)).otherwise(own(c)) if c in change else own(c)).alias(c)
        for c in docs.columns])
