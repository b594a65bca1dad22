"""Queries of the scoring service and its stores: validation, batch and stream scoring, histories from
two stores, live figures, and the statistics that need groups with NULL or real outliers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.coerce import safe_double
from ..functions.text import display_to_key, iso_text, key_to_display, pct_text
from ..operators import clean, evaluate, history, ml, ordered, stats, validate
from ..operators.staged import Staged
from ..schemas import (CODE_LABELS, DEFAULT_MODEL, FEATURE_KEYS, FORM_RULES, ROLLING_DIVISOR, TEST_FRACTION,
                       UNKNOWN_MODEL)
from ..session import shared_dir
from ..sources.tables import L_FEATURES, history_view, labelled_view, read_table
from .queries import (H, HS, L, _CMP_SQL, _comparison, _dbl, _tall_scores, _TALL_SQL, register, round_doubles)

# --------------------------------------------------------------------------- W1 on doubles


# Scores have two decimals, so means over 32 of them end in a 5 at the seventh place, where engines round
# either way. These means are cut at the sixth place after an offset that no such mean can meet.
_OFFSET = 0.318309886


@register("rolling_mean_percent", f"""
WITH c AS (SELECT CAST(greatest(1, count(*) // {ROLLING_DIVISOR}) AS INTEGER) AS w FROM events),
h AS (SELECT record_id, risk_percent, row_number() OVER (ORDER BY timestamp, record_id) AS row_index FROM {HS} h0)
SELECT record_id, row_index, round(risk_percent, 6) AS risk_percent,
  floor(avg(risk_percent) OVER (ORDER BY row_index ROWS BETWEEN (w - 1) PRECEDING AND CURRENT ROW) * 1000000 + {_dbl(_OFFSET)})
    / 1000000 AS rolling_mean, w AS window_rows FROM h, c""")
def q_rolling_mean_percent(spark, sf):
    """The trend of the real scores, as doubles."""
    h = stats.scored(history_view(spark, sf)).select("record_id", "timestamp", "risk_percent")
    r = ordered.rolling_mean(h, "risk_percent", ["timestamp", "record_id"], divisor=ROLLING_DIVISOR)
    mean = F.floor(F.col("rolling_mean") * F.lit(1e6) + F.lit(_OFFSET)) / F.lit(1e6)
    return round_doubles(r.select("record_id", "row_index", "risk_percent", mean.alias("rolling_mean"), "window_rows"))


@register("rolling_mean_gaps", """
WITH h AS (SELECT event_id AS record_id, CASE WHEN event_type <> 'error' THEN value END AS value,
  row_number() OVER (ORDER BY ts, event_id) AS row_index FROM events)
SELECT record_id, row_index, round(value, 6) AS value,
  round(avg(value) OVER (ORDER BY row_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM h""")
def q_rolling_mean_gaps(spark, sf):
    """Four-row frames over values with gaps: a frame without any value has no mean."""
    ev = read_table(spark, sf, "events").select(
        F.col("event_id").alias("record_id"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    r = ordered.rolling_mean(ev, "value", ["ts", "record_id"], window=4)
    return round_doubles(r.select("record_id", "row_index", "value", "rolling_mean"))


# --------------------------------------------------------------------------- groups with NULL, real outliers

_GROUPED = "(SELECT event_id AS record_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind, value FROM events)"
_FENCES = f"""
WITH e AS {_GROUPED},
q AS (SELECT kind, CAST(count(*) AS BIGINT) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM e GROUP BY kind),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
a AS (SELECT e.kind, min(value) FILTER (WHERE value BETWEEN lower_fence AND upper_fence) AS whisker_lo,
    max(value) FILTER (WHERE value BETWEEN lower_fence AND upper_fence) AS whisker_hi,
    count(*) FILTER (WHERE NOT value BETWEEN lower_fence AND upper_fence) AS n_outliers,
    min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS sd
  FROM e JOIN f ON e.kind IS NOT DISTINCT FROM f.kind GROUP BY e.kind)"""


def _grouped(spark, sf):
    """Long-tailed values by kind; errors have no kind."""
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("record_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), "value")


@register("kind_box_stats", _FENCES + """
SELECT f.kind, f.n, round(a.min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(a.max, 6) AS max, round(iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
  round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi, n_outliers, round(mean, 6) AS mean, round(sd, 6) AS sd
FROM f JOIN a ON f.kind IS NOT DISTINCT FROM a.kind""")
def q_kind_box_stats(spark, sf):
    return round_doubles(stats.box_stats(_grouped(spark, sf), "value", "kind"))


@register("kind_outliers", _FENCES + """
SELECT record_id, e.kind, round(value, 6) AS value, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence
FROM e JOIN f ON e.kind IS NOT DISTINCT FROM f.kind WHERE value < lower_fence OR value > upper_fence""")
def q_kind_outliers(spark, sf):
    return round_doubles(stats.outliers(_grouped(spark, sf), "record_id", "value", "kind"))


@register("kind_density", _FENCES + """,
p AS (SELECT f.kind, f.n, a.min, a.max,
    0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.349) ELSE sd END * pow(CAST(f.n AS DOUBLE), -0.2) AS bw
  FROM f JOIN a ON f.kind IS NOT DISTINCT FROM a.kind),
g AS (SELECT p.*, CAST(range AS INTEGER) AS k, p.min + range * (p.max - p.min) / CAST(49 AS DOUBLE) AS x FROM p, range(0, 50) WHERE bw > 0)
SELECT g.kind, g.k, round(g.x, 6) AS x, round(sum(exp(-0.5 * ((g.x - e.value) / bw) * ((g.x - e.value) / bw))
  / (bw * sqrt(2 * pi()))) / max(g.n), 6) AS density
FROM g JOIN e ON g.kind IS NOT DISTINCT FROM e.kind GROUP BY g.kind, g.k, g.x""")
def q_kind_density(spark, sf):
    """The violin over values with outliers, whose far grid points no value is near."""
    return round_doubles(stats.density(_grouped(spark, sf), "value", "kind", 50))


# --------------------------------------------------------------------------- 14 columns with holes

_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "discount", "tax",
         "returned", "open", "ship_day", "ship_month", "unit_price", "net"]
_WIDE_SQL = """(SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_partkey AS DOUBLE) AS l_partkey,
  CAST(l_suppkey AS DOUBLE) AS l_suppkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_extendedprice,
  nullif(l_discount, CAST(0 AS DOUBLE)) AS discount, nullif(l_tax, CAST(0 AS DOUBLE)) AS tax,
  CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE 0 END AS returned,
  CASE WHEN l_linestatus = 'O' THEN CAST(1 AS DOUBLE) ELSE 0 END AS open,
  CAST(day(l_shipdate) AS DOUBLE) AS ship_day, CAST(month(l_shipdate) AS DOUBLE) AS ship_month,
  l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - nullif(l_discount, CAST(0 AS DOUBLE))) AS net FROM lineitem)"""


@register("corr_wide", f"WITH t AS {_WIDE_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL)"
    f" * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL), 0), 6) AS r FROM t" for a in _WIDE for b in _WIDE))
def q_corr_wide(spark, sf):
    """The whole matrix of 14 columns, pairwise complete, in one pass."""
    li = read_table(spark, sf, "lineitem")
    gone = F.nullif(F.col("l_discount"), F.lit(0.0))
    t = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  gone.alias("discount"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
                  F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("returned"),
                  F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("open"),
                  F.dayofmonth("l_shipdate").alias("ship_day"), F.month("l_shipdate").alias("ship_month"),
                  (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                  (F.col("l_extendedprice") * (F.lit(1.0) - gone)).alias("net"))
    return round_doubles(stats.corr_matrix(t, _WIDE))


# --------------------------------------------------------------------------- scoring with known coefficients

# Two fitted models as (intercept, one coefficient per L feature): what a trained pipeline holds.
FIXED = {"logistic_regression": (-1.5, [0.04, -0.00001, 2.0, -3.0]), DEFAULT_MODEL: (0.5, [-0.03, 0.00002, 1.0, 4.0])}
_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _form_requests(spark, sf):
    """Requests over L as a service gets them: every feature as text, some missing or no number."""
    l = labelled_view(spark, sf)
    return l.select(
        *_KEY, F.when(F.col("l_linenumber") <= 3, F.lit("logistic_regression")).when(F.col("l_linenumber") == 4, F.lit("svm"))
        .alias("model"),
        F.when(F.col("l_quantity") == 13, F.lit("abc")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.col("l_extendedprice").cast("string").alias("l_extendedprice"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).cast("string").alias("l_discount"),
        F.when(F.col("l_tax") == 0.05, F.lit("NaN")).otherwise(F.col("l_tax").cast("string")).alias("l_tax"))


def _fixed_sql(key: str) -> str:
    b0, b = FIXED[key]
    return f"1 / (1 + exp(-({_dbl(b0)} + " + " + ".join(f"{_dbl(x)} * {c}" for x, c in zip(b, L_FEATURES)) + ")))"


_SCORED_SQL = f"""
WITH r AS (SELECT *, l_quantity = 13 AS b1, l_discount = 0 AS b3, l_tax = CAST('0.05' AS DOUBLE) AS b4,
    CASE WHEN l_linenumber <= 3 THEN 'logistic_regression' ELSE '{DEFAULT_MODEL}' END AS model_used FROM {L} l),
p AS (SELECT *, CASE WHEN model_used = 'logistic_regression' THEN {_fixed_sql('logistic_regression')}
    ELSE {_fixed_sql(DEFAULT_MODEL)} END AS p, b1 OR b3 OR b4 AS bad FROM r)"""


def _fixed_models(spark) -> dict:
    """The fixed pipelines after a save and a load."""
    from ..sources.artifacts import load_models, save_models
    root = shared_dir(spark, f"riskspark-fixed-{uuid.uuid4().hex}")
    save_models(spark, {k: ml.logistic_pipeline(spark, L_FEATURES, b, b0) for k, (b0, b) in FIXED.items()}, root)
    return load_models(spark, list(FIXED), root)


@register("score_requests", _SCORED_SQL + f"""
SELECT {', '.join(_KEY)}, CASE WHEN NOT bad THEN model_used END AS model_used,
  CASE WHEN NOT bad THEN CAST(p > 0.5 AS INTEGER) END AS prediction, CASE WHEN NOT bad THEN round(p, 6) END AS probability,
  concat_ws(',', CASE WHEN b1 THEN 'l_quantity' END, CASE WHEN b3 THEN 'l_discount' END, CASE WHEN b4 THEN 'l_tax' END) AS bad_features
FROM p""")
def q_score_requests(spark, sf):
    """Requests are validated, bad ones rejected with the features at
    fault, the others scored by the saved and reloaded pipeline they name."""
    good, bad = validate.staged_requests(_form_requests(spark, sf), L_FEATURES, Staged(spark, "requests"))
    scored = ml.score_by_model(_fixed_models(spark), good.withColumn("model_used", validate.choose_model("model")))
    out = scored.select(*_KEY, "model_used", "prediction", "probability", F.lit("").alias("bad_features"))
    return round_doubles(out.unionByName(bad.select(*_KEY, F.array_join("bad_features", ",").alias("bad_features")),
                                         allowMissingColumns=True))


@register("stream_scores", _SCORED_SQL + f"""
SELECT {', '.join(_KEY)}, model_used, CAST(p > 0.5 AS INTEGER) AS prediction, round(p, 6) AS probability, 'fallback' AS source
FROM p WHERE NOT bad""")
def q_stream_scores(spark, sf):
    """R1 end to end: the requests arrive as files of JSON lines; each micro-batch is validated,
    scored and stored. The primary store is out of reach, so the rows are read back, once each, from
    the fallback."""
    from ..sources.sinks import read_stored
    from ..streaming.jobs import score_stream
    root = shared_dir(spark, f"riskspark-scores-{uuid.uuid4().hex}")
    requests = _form_requests(spark, sf)
    requests.write.json(f"{root}/in")
    store = [f"{root}/primary", f"{root}/fallback"]
    score_stream(spark, f"{root}/in", requests.schema, _fixed_models(spark), {"path": store[0], "fmt": "unreachable_store"},
                 {"path": store[1]}, f"{root}/checkpoint", feature_cols=L_FEATURES,
                 rejected={"path": f"{root}/rejected"}).awaitTermination()
    return round_doubles(read_stored(spark, *store).select(*_KEY, "model_used", "prediction", "probability", "source"))


# --------------------------------------------------------------------------- stores and histories

@register("store_failover", """
SELECT event_id AS record_id, CASE WHEN event_type IN ('click', 'signup') THEN 'fallback' ELSE 'primary' END AS source FROM events""")
def q_store_failover(spark, sf):
    """K3 over the history in four writes: one that works, one whose primary fails in its commit, one
    whose primary cannot be written, and one that fell over and is then delivered again. Readers
    see every row once."""
    from ..sources import sinks
    h = history_view(spark, sf)
    root = shared_dir(spark, f"riskspark-store-{uuid.uuid4().hex}")
    primary, fallback = {"path": f"{root}/primary"}, {"path": f"{root}/fallback"}
    closed = {"path": f"{root}/primary", "fmt": "unreachable_store"}

    def lost(spark, path, write_id):
        if path == primary["path"]:
            raise IOError("the store went away during the commit")
        sinks.commit(spark, path, write_id)

    part = lambda *kinds: h.where(F.col("model_used").isin(*kinds))
    sinks.append_with_fallback(part("view", "error"), primary, fallback, batch_id=1)
    sinks.append_with_fallback(part("click"), primary, fallback, batch_id=2, commit=lost)
    sinks.append_with_fallback(part("signup"), closed, fallback, batch_id=3)
    sinks.append_with_fallback(part("purchase"), closed, fallback, batch_id=4)
    sinks.append_with_fallback(part("purchase"), primary, fallback, batch_id=4)
    return sinks.read_stored(spark, primary["path"], fallback["path"]).select("record_id", "source")


def _texts(spark, sf):
    """Records as JSON texts: error rows say ``"model_used": null``, views do not name the key, and every
    third record keeps its features inside ``input_data`` (chol there null for every ninth)."""
    ev = read_table(spark, sf, "events")
    inner = F.concat(F.lit('{"age": '), F.col("user_id").cast("string"), F.lit(', "chol": '),
                     F.when(F.col("event_id") % 9 == 0, F.lit("null")).otherwise(F.col("value").cast("string")), F.lit("}"))
    model = F.when(F.col("event_type") == "error", F.lit(', "model_used": null')).when(F.col("event_type") == "view", F.lit("")) \
             .otherwise(F.concat(F.lit(', "model_used": "'), F.col("event_type"), F.lit('"')))
    head = F.concat(F.lit('{"chol": 7.5, "ca": '), F.get_json_object("props", "$.k"))
    return ev.select(F.col("event_id").alias("record_id"), F.concat(
        head, F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "input_data": '), inner)).otherwise(F.lit("")),
        model, F.lit("}")).alias("json"))


@register("strict_defaults", f"""
SELECT event_id AS record_id, round(CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS DOUBLE) END, 6) AS age,
  round(CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 3 = 0 THEN value ELSE 7.5 END, 6) AS chol,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ca, CAST(NULL AS DOUBLE) AS thal,
  CASE WHEN event_type = 'view' THEN '{UNKNOWN_MODEL}' WHEN event_type <> 'error' THEN event_type END AS model_strict,
  CASE WHEN event_type IN ('view', 'error') THEN '{UNKNOWN_MODEL}' ELSE event_type END AS model_filled FROM events""")
def q_strict_defaults(spark, sf):
    """P12 in both modes (T6): strict fills a model only where the key is absent."""
    texts = _texts(spark, sf)
    strict = history.normalise_json(texts, carry=["record_id", "json"], strict=True).withColumnRenamed("model_used", "model_strict")
    both = history.normalise_json(strict, carry=["record_id", "model_strict"], keys=["age", "chol", "ca", "thal"], strict=False)
    return round_doubles(both.select("record_id", "age", "chol", "ca", "thal", "model_strict",
                                     F.col("model_used").alias("model_filled")))


_MERGED = {"age": "CAST(user_id AS DOUBLE)", "chol": "value", "ca": "CAST(json_extract_string(props, '$.k') AS DOUBLE)"}


@register("history_merged", f"""
SELECT event_id AS record_id, ts AS timestamp, """ + ", ".join(
    f"round({_MERGED[k]}, 6) AS {k}" if k in _MERGED else f"CAST(NULL AS DOUBLE) AS {k}" for k in FEATURE_KEYS) + f""",
  CASE WHEN event_type = 'error' THEN '{UNKNOWN_MODEL}' ELSE event_type END AS model_used,
  round(least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)), 6) AS probability,
  CASE WHEN event_type IN ('error', 'view') THEN 'fallback' ELSE 'primary' END AS source FROM events""")
def q_history_merged(spark, sf):
    """O1 with P10-P15: the primary keeps flat records and times, the fallback nested records, ISO
    texts and a store key; merged, both have all 13 features, a model and a time."""
    ev = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    base = [F.col("event_id").alias("record_id"), F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("probability")]
    flat = [F.col("user_id").cast("double").alias("age"), F.col("value").alias("chol"), k.alias("ca")]
    old = F.col("event_type").isin("error", "view")
    primary = ev.where(~old).select(*base, *flat, F.col("ts").alias("timestamp"), F.col("event_type").alias("model_used"))
    fallback = ev.where(old).select(
        *base, F.col("event_id").cast("string").alias("_id"), F.struct(*flat).alias("input_data"), iso_text("ts").alias("timestamp"),
        F.when(F.col("event_type") == "view", F.col("event_type")).alias("model_used"))
    u = history.union_history(primary, fallback)
    return round_doubles(u.select("record_id", "timestamp", *FEATURE_KEYS, "model_used", "probability", "source"))


@register("live_kpis", """
WITH h AS (SELECT ts, least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS probability FROM events)
SELECT date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS total,
    count(*) FILTER (WHERE probability < CAST('0.3' AS DOUBLE)) AS low_n,
    count(*) FILTER (WHERE probability >= CAST('0.3' AS DOUBLE) AND probability < CAST('0.6' AS DOUBLE)) AS moderate_n,
    count(*) FILTER (WHERE probability >= CAST('0.6' AS DOUBLE)) AS high_n,
    count(*) FILTER (WHERE probability * CAST(100 AS DOUBLE) > CAST(60 AS DOUBLE)) AS over_60_n,
    round(avg(probability), 6) AS avg_probability FROM h GROUP BY 1""")
def q_live_kpis(spark, sf):
    """R2 live: all days, the open ones too, by an update-mode stream and keyed upserts."""
    from ..streaming.jobs import stream_live_kpis
    return round_doubles(stream_live_kpis(spark, sf, glob="events.parquet"))


# --------------------------------------------------------------------------- forms

_FORM_SQL = {"age": "event_id % 130", "sex": "event_id % 3", "cp": "event_id % 5", "chol": "CAST(value AS DOUBLE) - 5",
             "thal": "user_id % 4", "slope": "user_id % 3"}
_FORM_RULES = [r for r in FORM_RULES if r[0] in _FORM_SQL]
_FORM_LABELS = [t for t in CODE_LABELS if t[0] in _FORM_SQL]


def _rule_sql(rule) -> str:
    col, lo, hi, allowed = rule
    parts = [f"{col} < {_dbl(lo)}"] if lo is not None else []
    parts += [f"{col} > {_dbl(hi)}"] if hi is not None else []
    parts += [f"{col} NOT IN ({', '.join(map(_dbl, allowed))})"] if allowed is not None else []
    return f"CASE WHEN {' OR '.join(parts)} THEN '{col}' END"


@register("form_check", "WITH f AS (SELECT event_id AS record_id, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {c}" for c, e in _FORM_SQL.items()) + " FROM events) SELECT record_id, concat_ws(',', "
    + ", ".join(_rule_sql(r) for r in _FORM_RULES) + ") AS violations, " + ", ".join(
    f"CASE {c} " + " ".join(f"WHEN {k} THEN '{t}'" for x, k, t in _FORM_LABELS if x == c) + f" END AS {c}_label"
    for c in dict.fromkeys(t[0] for t in _FORM_LABELS)) + " FROM f")
def q_form_check(spark, sf):
    """P26 and P27 with the form's own ranges, code sets and labels."""
    ev = read_table(spark, sf, "events")
    f = ev.select(F.col("event_id").alias("record_id"), *[
        F.expr(e).cast("double").alias(c) for c, e in _FORM_SQL.items()])
    checked = validate.decode_codes(validate.rule_violations(f, _FORM_RULES), _FORM_LABELS)
    return checked.select("record_id", F.array_join("violations", ",").alias("violations"),
                          *[f"{c}_label" for c in dict.fromkeys(t[0] for t in _FORM_LABELS)])


@register("clean_texts", """
WITH t AS (SELECT event_id AS record_id, CASE WHEN event_type <> 'error' THEN value END AS amount,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, upper(event_type[1]) || event_type[2:] || ' Model' AS name FROM events)
SELECT record_id, round(amount, 6) AS amount, k, format('{:.2f}%', amount) AS amount_text,
  lower(replace(name, ' ', '_')) AS key, name AS display FROM t WHERE amount IS NOT NULL AND k IS NOT NULL""")
def q_clean_texts(spark, sf):
    """P1, P3, P17, P20 and P22 in both directions: junk amounts become NULL, incomplete rows go."""
    ev = read_table(spark, sf, "events")
    t = ev.select(F.col("event_id").alias("record_id"),
                  F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("amount"),
                  F.get_json_object("props", "$.k").alias("k"),
                  F.concat(F.initcap("event_type"), F.lit(" Model")).alias("name"))
    t = clean.drop_incomplete(clean.coerce_numeric(t, ["amount", "k"], strict=False), ["amount", "k"])
    key = display_to_key("name")
    return round_doubles(t.select("record_id", "amount", "k", pct_text(safe_double("amount") / F.lit(100.0), 2).alias("amount_text"),
                                  key.alias("key"), key_to_display(key).alias("display")))


# --------------------------------------------------------------------------- models

@register("comparison_null_model", f"""
WITH s AS (SELECT CASE WHEN model <> 'Random Forest' THEN model END AS model, label, score FROM {_TALL_SQL} t),
g AS (SELECT model, score, sum(label) AS tp, count(*) - sum(label) AS fp FROM s GROUP BY ALL),
t AS (SELECT model, sum(tp) AS n_pos, sum(fp) AS n_neg FROM g GROUP BY model),
c AS (SELECT g.*, sum(tp) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp FROM g),
auc AS (SELECT c.model, sum(fp * (2.0 * cum_tp - tp)) / nullif(2.0 * max(n_pos) * max(n_neg), 0) AS roc_auc
        FROM c JOIN t ON c.model IS NOT DISTINCT FROM t.model GROUP BY c.model),
acc AS (SELECT model, avg(CASE WHEN (score > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM s GROUP BY model)
SELECT acc.model, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc
FROM acc JOIN auc ON acc.model IS NOT DISTINCT FROM auc.model""")
def q_comparison_null_model(spark, sf):
    """E5 where one model has no name: its rows are a group of their own."""
    s = _tall_scores(spark, sf).select(F.when(F.col("model") != "Random Forest", F.col("model")).alias("model"), "label", "score")
    return round_doubles(evaluate.compare_models(s, "model", "score", "label").select("model", "accuracy", "roc_auc"))


@register("run_summary", _CMP_SQL + f""",
best AS (SELECT model, position FROM cmp ORDER BY accuracy DESC, position LIMIT 1),
m AS (SELECT s.* FROM s JOIN best USING (model)),
k AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp,
  count(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn,
  count(*) FILTER (WHERE label = 0 AND score <= 0.5) AS tn FROM m),
e AS (SELECT n, (tp + tn) / n AS accuracy, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
  coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
  coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1_score FROM k)
SELECT 'dataset' AS section, 'features' AS item, CAST(NULL AS VARCHAR) AS value, CAST({len(L_FEATURES)} AS DOUBLE) AS number
UNION ALL SELECT 'dataset', 'target', 'returned', NULL UNION ALL SELECT 'preparation', 'missing values', 'median of train split', NULL
UNION ALL SELECT 'preparation', 'scaling', 'mean and population sd of train split', NULL
UNION ALL SELECT 'preparation', 'test share', NULL, {TEST_FRACTION} UNION ALL SELECT 'selection', 'criterion', 'highest accuracy', NULL
UNION ALL SELECT 'dataset', 'rows', NULL, count(*) FROM lineitem
UNION ALL SELECT 'candidates', CAST(position AS VARCHAR), model, NULL FROM cmp
UNION ALL SELECT 'selection', 'best model', model, NULL FROM best
UNION ALL SELECT 'metrics', 'accuracy', NULL, round(accuracy, 6) FROM e UNION ALL SELECT 'metrics', 'precision', NULL, round(precision, 6) FROM e
UNION ALL SELECT 'metrics', 'recall', NULL, round(recall, 6) FROM e UNION ALL SELECT 'metrics', 'f1_score', NULL, round(f1_score, 6) FROM e
UNION ALL SELECT 'metrics', 'roc_auc', NULL, round(roc_auc, 6) FROM cmp JOIN best USING (model)""")
def q_run_summary(spark, sf):
    """M11 over three fixed score columns."""
    cmp = _comparison(spark, sf)
    pred = _tall_scores(spark, sf).withColumn("prediction", (F.col("score") > F.lit(0.5)).cast("int"))
    m = evaluate.classification_metrics(pred, "label", "prediction", ["model"]).select(
        "model", "accuracy", "precision", "recall", "f1_score").join(F.broadcast(cmp.select("model", "roc_auc")), "model")  # a row a model
    return round_doubles(ml.run_summary(labelled_view(spark, sf), L_FEATURES, cmp, m, "returned"))


@register("importance_ranks", f"""
WITH i AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(covar_pop({c}, label) / nullif(stddev_pop({c}) * stddev_pop(label), 0)) AS importance FROM {L} l"
    for c in L_FEATURES) + """)
SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
  CAST(row_number() OVER (ORDER BY importance, feature) AS INTEGER) AS rank_ascending FROM i""")
def q_importance_ranks(spark, sf):
    """The importance table with its ascending arg-sort beside the descending one."""
    c = stats.corr_matrix(labelled_view(spark, sf), L_FEATURES + ["label"], pairs=[(f, "label") for f in L_FEATURES])
    imp = c.select(F.lit("correlation").alias("model"), F.col("x").alias("feature"), F.abs(F.col("r")).alias("importance"))
    return round_doubles(ml.with_ranks(imp).select("feature", "importance", "rank", "rank_ascending"))


# --------------------------------------------------------------------------- every file format, by value

def _facts(step: str, values: dict[str, str], frm: str) -> str:
    return " UNION ALL ".join(f"SELECT '{step}' AS step, '{k}' AS item, round(CAST({e} AS DOUBLE), 6) AS value FROM {frm}"
                              for k, e in values.items())


_IO_SQL = _CMP_SQL + f""",
cells AS (SELECT label AS actual, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS predicted FROM {L} l),
k AS (SELECT count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp,
  count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn FROM cells),
""" + """e AS (SELECT (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
  coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1_score FROM k)
""" + " UNION ALL ".join([
    _facts("history", {"rows": "count(*)", "probability": "avg(probability)", "records": "count(DISTINCT record_id)",
                       "days": "count(DISTINCT CAST(timestamp AS DATE))", "store_keys": "max(0)"}, f"{H} h"),
    _facts("history_json", {"rows": "count(*)", "probability": "avg(probability)", "entity_id": "avg(entity_id)",
                            "micros": "avg(extract('microsecond' FROM timestamp))"}, f"{H} h"),
    _facts("json_column", {"record_id": "avg(record_id)"}, f"{H} h"),
    _facts("training_csv", {c: f"avg(nullif({c}, CAST(0 AS DOUBLE)))" for c in L_FEATURES}
           | {f"{c}_missing": f"count(*) FILTER (WHERE {c} = 0)" for c in L_FEATURES} | {"target": "avg(label)"}, f"{L} l"),
    _facts("metrics", {c: c for c in ("accuracy", "precision", "recall", "f1_score")}, "e"),
    _facts("metrics", {"roc_auc": "roc_auc"}, "cmp WHERE position = 0"),
    "SELECT 'comparison', model || ' accuracy', round(accuracy, 6) FROM cmp UNION ALL "
    "SELECT 'comparison', model || ' roc_auc', round(roc_auc, 6) FROM cmp",
    "SELECT 'confusion', c || '', n FROM (SELECT unnest([0, 1, 10, 11]) AS c, unnest([tn, fp, fn, tp]) AS n FROM k)"])


@register("io_values", _IO_SQL)
def q_io_values(spark, sf):
    """Every source and sink (S1-S6, S9, K1-K6, K8) by value: the tables are written in each format, read
    back, and told as (step, item, value)."""
    from ..schemas import SCORE_RECORD_SCHEMA  # noqa: F401  the schema of a real history
    from ..sources import files, sinks
    root = shared_dir(spark, f"riskspark-values-{uuid.uuid4().hex}")
    h, l = history_view(spark, sf), labelled_view(spark, sf)

    def told(df, step: str, **values):
        cells = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(k).alias("item"), v.cast("double").alias("value")) for k, v in values.items()])
        return df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")

    for odd in (0, 1):  # two appends
        sinks.append_history(h.where(F.col("record_id") % 2 == odd).withColumn("_id", F.col("record_id").cast("string")), f"{root}/history")
    back = files.read_history(spark, f"{root}/history")
    sinks.export_history(h, f"{root}/json")
    lines = files.read_history_json(spark, f"{root}/json", h.schema)
    column = sinks.history_as_json(h).select(F.get_json_object("json", "$.record_id").cast("long").alias("record_id"))
    text = l.select(*[F.coalesce(F.nullif(F.col(c), F.lit(0.0)).cast("string"), F.lit("?")).alias(c) for c in L_FEATURES], F.col("label").cast("string"))
    text.write.option("header", False).csv(f"{root}/csv")
    schema = spark.createDataFrame([], ", ".join(f"{c} double" for c in [*L_FEATURES, "target"])).schema
    train = files.read_training(spark, f"{root}/csv", schema=schema)
    pred = l.withColumn("prediction", (F.col("score") > F.lit(0.5)).cast("int"))
    cmp = _comparison(spark, sf).select("model", "accuracy", "roc_auc").collect()  # a row a model
    auc = {r["model"]: r["roc_auc"] for r in cmp}["Logistic Regression"]
    one = evaluate.classification_metrics(pred).select("accuracy", "precision", "recall", "f1_score").withColumn("roc_auc", F.lit(auc).cast("double"))
    sinks.write_metrics(one, f"{root}/metrics")
    sinks.write_comparison([tuple(r) for r in cmp], spark, f"{root}/comparison")
    sinks.write_confusion(evaluate.confusion(pred), f"{root}/confusion")
    metrics = files.read_metrics(spark, f"{root}/metrics")
    models = files.read_comparison(spark, f"{root}/comparison")
    cells = files.read_confusion(spark, f"{root}/confusion")
    n = F.count(F.lit(1))
    parts = [
        told(back, "history", rows=n, probability=F.avg("probability"), records=F.count_distinct("record_id"),
             days=F.count_distinct("score_date"), store_keys=F.lit(int("_id" in back.columns))),
        told(lines, "history_json", rows=n, probability=F.avg("probability"), entity_id=F.avg("entity_id"),
             micros=F.avg((F.date_part(F.lit("SECOND"), "timestamp") * 1_000_000).cast("double"))),
        told(column, "json_column", record_id=F.avg("record_id")),
        told(train, "training_csv", **{c: F.avg(c) for c in L_FEATURES}, **{f"{c}_missing": F.count_if(F.col(c).isNull()) for c in L_FEATURES},
             target=F.avg("target")),
        told(metrics, "metrics", **{c: F.max(c) for c in metrics.columns}),
        models.select(F.lit("comparison").alias("step"), F.concat("model", F.lit(" accuracy")).alias("item"), F.col("accuracy").alias("value")),
        models.select(F.lit("comparison").alias("step"), F.concat("model", F.lit(" roc_auc")).alias("item"), F.col("roc_auc").alias("value")),
        cells.select(F.lit("confusion").alias("step"), (F.col("actual") * 10 + F.col("predicted")).cast("string").alias("item"),
                     F.col("n").cast("double").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return round_doubles(out)
