"""Chat formatting from an event log (operator 8), in SQL functions only.

The log holds one row per event of a message: ``message`` and ``regenerate`` start its text
anew, ``edit`` replaces it, ``delta`` appends to it, ``delete`` takes the message away. Events
are folded per message first (so the deltas of a long conversation spread over tasks), then
the messages of a conversation are put in order and rendered::

    <turn ROLE>TEXT</turn>

Inside roles and texts every backslash, ``<`` and ``>`` is written as a backslash and a letter,
so a rendered ``<`` or ``>`` is always the template's own, and the writing is undone exactly.

Defined results: null role, kind or text count as empty (an empty kind is ``message``); a null
conv_id is a conversation of its own; events that tie are taken in the order of kind, then text;
a repeated event is applied as often as it stands in the log; an empty log gives no rows. One
conversation is one rendered string, so it must fit the 2 GB of a Spark string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import chunks, let, running
from .common import Staging, read_table

OPEN, SHUT, CLOSE = "<turn ", ">", "</turn>\n"
LEARNED_ROLE = "assistant"
PROBE_TEXT = "\\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    c = F.replace(c, F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\g"), F.lit(">"))
    c = F.replace(c, F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, role, text) of a log (conv_id, message_id, seq, kind, role, text).

    ``message_id`` may be any sortable type. The text is all events from the last one that sets
    it; a role comes from the last event that names one.
    """
    log = log.select("conv_id", "message_id", "seq",
                     F.coalesce(F.nullif(F.lower(F.col("kind")), F.lit("")), F.lit("message")).alias("kind"),
                     "role", F.coalesce("text", F.lit("")).alias("text"))
    by = log.groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("e"))
    sets = F.transform(F.col("e"), lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(-1)))
    by = by.withColumn("last", F.greatest(F.array_max(sets), F.lit(0)))
    alive = F.element_at("e", F.col("last") + 1)["kind"] != "delete"
    live = F.expr("slice(e, last + 1, size(e))")
    text = F.array_join(F.transform(live, lambda x: x["text"]), "")
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull() & (r != ""))
    return by.where(alive).select(
        "conv_id", "message_id", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the rendered text and, per turn, the span under the loss mask.

    ``loss`` has an entry for every turn: code point offsets (first, past the last) of its text
    in ``formatted`` if the turn is learned, null if it is not.
    """
    turns = messages.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("message_id", "role", "text"))).alias("m"))
    head = F.transform("m", lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(SHUT)))
    body = F.transform("m", lambda x: escape(x["text"]))
    t = turns.select("conv_id", "m", head.alias("head"), body.alias("body"))
    size = F.zip_with("head", "body", lambda h, b: F.struct(F.length(h).alias("h"), F.length(b).alias("b")))
    t = t.select("conv_id", "head", "body", F.transform("m", lambda x: x["role"] == LEARNED_ROLE).alias("learned"),
                 size.alias("size"))
    # Where each turn's text begins: the lengths of all before it and of its own head.
    start = running(F.col("size"), lambda z: (z["h"] + z["b"] + len(CLOSE)).cast("long"), lambda at, z: at + z["h"], "array<bigint>")
    t = t.withColumn("start", start)
    spans = F.zip_with(
        F.arrays_zip("start", "size"), "learned",
        lambda s, yes: F.when(yes, F.struct(s["start"].alias("first"), (s["start"] + s["size"]["b"]).alias("past"))))
    return t.select(
        "conv_id",
        F.array_join(F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(CLOSE))), "").alias("formatted"),
        spans.alias("loss"))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The text of every span of the loss mask (empty where a turn is not learned), cut from the
    formatted text by the stored offsets. Long conversations are cut in stretches of turns first."""
    first = lambda c: F.array_min(F.transform(F.filter(c, lambda s: s.isNotNull()), lambda s: s["first"]))
    past = lambda c: F.array_max(F.transform(F.filter(c, lambda s: s.isNotNull()), lambda s: s["past"]))
    cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))

    def stretch(c):
        return let(F.struct(first(c).alias("at"), cut(formatted, first(c), past(c)).alias("text")), lambda part: F.transform(
            c, lambda s: F.when(s.isNull(), F.lit("")).otherwise(cut(part["text"], s["first"] - part["at"], s["past"] - part["at"]))))

    return let(chunks(loss), lambda c: F.flatten(F.transform(c, stretch)))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array of role and text, learned: text under the mask, formatted_chars).

    Turns come from the template, the learned text from the mask's offsets alone; where the two
    disagree the mask does not fit the text and the job fails."""
    parts = F.filter(F.split("formatted", "<turn "), lambda x: x != "")
    cut = F.transform(parts, lambda x: F.struct(
        F.substring_index(x, ">", 1).alias("role"),
        F.substring_index(F.substring_index(x, "</turn>", 1), ">", -1).alias("body")))
    f = formatted.select("conv_id", "loss", F.length("formatted").alias("formatted_chars"), cut.alias("cut"),
                         under_mask(F.col("formatted"), F.col("loss")).alias("masked"))
    fits = F.forall(F.arrays_zip("cut", "masked", "loss"), lambda x: x["loss"].isNull() | (x["cut"]["body"] == x["masked"]))
    learned = F.when(fits, F.array_join("masked", "")).otherwise(
        F.raise_error(F.lit("the loss mask does not fit the formatted text")))
    return f.select(
        "conv_id", "formatted_chars",
        F.transform("cut", lambda c: F.struct(unescape(c["role"]).alias("role"), unescape(c["body"]).alias("text"))).alias("turns"),
        unescape(learned).alias("learned"))


def conversation_log(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log that such a conversation leaves; rows of one turn
    stay apart. An assistant's text is begun, thrown away and streamed anew in three deltas, a
    user's is sent half written and then edited, any other is one message."""
    same = F.row_number().over(_rows_of_a_turn())
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", same.alias("copy")).alias("message_id"), "role", "text")
    n = F.ceil(F.length("text") / F.lit(3)).cast("int")
    piece = lambda i: F.substring("text", n * i + 1, n)
    draft = F.substring("text", F.lit(1), F.least(n, F.lit(12)))

    def events(*some):
        return F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), (F.col("role") if i == 0 else F.lit(None).cast(
            "string")).alias("role"), text.alias("text")) for i, (kind, text) in enumerate(some)])

    streamed = events(("message", F.lit("")), ("delta", draft), ("regenerate", F.lit("")), ("delta", piece(0)), ("delta", piece(1)), ("delta", piece(2)))
    edited = events(("message", draft), ("edit", F.col("text")))
    log = F.when(F.col("role") == LEARNED_ROLE, streamed).when(F.col("role") == "user", edited).otherwise(events(("message", F.col("text"))))
    return rows.select("conv_id", "message_id", F.explode(log).alias("e")).select("conv_id", "message_id", "e.*")


def _rows_of_a_turn():
    from pyspark.sql import Window
    return Window.partitionBy("conv_id", "turn").orderBy("role", "text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7, formatted, written, and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    stage = Staging(spark, "chat")
    formatted = stage.write(render(fold_events(conversation_log(rows.unionByName(probe)))), "formatted")
    back = read_back(formatted)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS er,
         replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') AS et FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(er) + length(et) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
