"""Named queries over the provided tables, each with an equivalent DuckDB SQL oracle.

H = score history over ``events``, L = labelled rows over ``lineitem`` (see
``sources.tables``). Doubles are rounded to 6 places on both sides; counts are BIGINT.
Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import band_sql, confidence, guidance, risk_band, risk_percent
from ..functions.text import display_time, iso_text, key_to_display, parse_iso
from ..operators import clean, evaluate, history, ordered, stats, validate
from ..schemas import (BAND_GUIDANCE, BAND_NAMES, CLASS_NAMES, DEFAULT_MODEL, DEFAULT_MODEL_COLOR, MODEL_COLORS,
                       MODEL_KEYS, ROLLING_DIVISOR, UNKNOWN_MODEL)
from ..sources.tables import (HISTORY_SQL, L_FEATURES, LABELLED_SQL, history_view, labelled_view,
                              read_table)

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

H = f"({HISTORY_SQL})"
L = f"({LABELLED_SQL})"
HS = (f"(SELECT *, probability * CAST(100 AS DOUBLE) AS risk_percent, "
      f"{band_sql('probability')} AS risk_band FROM {H})")


def register(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])


def hist_h(spark, sf):
    return stats.scored(history_view(spark, sf))


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


# --------------------------------------------------------------------------- H: KPIs

@register("risk_kpis", f"""
SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(sum(CASE WHEN risk_band = 'Low' THEN 1 ELSE 0 END) AS BIGINT) AS low_n,
  CAST(sum(CASE WHEN risk_band = 'Moderate' THEN 1 ELSE 0 END) AS BIGINT) AS moderate_n,
  CAST(sum(CASE WHEN risk_band = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_n,
  CAST(sum(CASE WHEN risk_percent > CAST(60 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS over_60_n,
  round(avg(probability), 6) AS avg_probability, round(avg(risk_percent), 6) AS avg_risk_percent,
  round(sum(CASE WHEN risk_band = 'Low' THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*), 6) AS low_share,
  round(sum(CASE WHEN risk_band = 'Moderate' THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*), 6) AS moderate_share,
  round(sum(CASE WHEN risk_band = 'High' THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*), 6) AS high_share,
  round(sum(CASE WHEN risk_percent > CAST(60 AS DOUBLE) THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / count(*), 6) AS over_60_share,
  {band_sql('avg(probability)')} AS avg_band
FROM {HS} h""")
def q_risk_kpis(spark, sf):
    return round_doubles(stats.risk_kpis(history_view(spark, sf)))


@register("risk_distribution", f"""
SELECT risk_band, CAST(count(*) AS BIGINT) AS n,
  round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 6) AS share
FROM {HS} h GROUP BY risk_band""")
def q_risk_distribution(spark, sf):
    return round_doubles(stats.risk_distribution(history_view(spark, sf)))


@register("score_summary", f"""
SELECT CAST(count(risk_percent) AS BIGINT) AS n, round(min(risk_percent), 6) AS min,
  round(quantile_cont(risk_percent, 0.25), 6) AS q25, round(quantile_cont(risk_percent, 0.5), 6) AS median,
  round(quantile_cont(risk_percent, 0.75), 6) AS q75, round(max(risk_percent), 6) AS max,
  round(avg(risk_percent), 6) AS mean, round(stddev_samp(risk_percent), 6) AS sd
FROM {HS} h""")
def q_score_summary(spark, sf):
    return round_doubles(stats.score_summary(hist_h(spark, sf), "risk_percent"))


def _hist_sql() -> str:
    edges = stats.hist_edges()
    case = " ".join(f"WHEN risk_percent < {_dbl(edges[i])} THEN {i}" for i in range(1, len(edges) - 1))
    bins = len(edges) - 1
    lo = " ".join(f"WHEN {i + 1} THEN {_dbl(edges[i])}" for i in range(bins))
    hi = " ".join(f"WHEN {i + 1} THEN {_dbl(edges[i + 1])}" for i in range(bins))
    return f"""
WITH c AS (SELECT CASE {case} ELSE {bins} END AS bin, count(*) AS n FROM {HS} h
           WHERE risk_percent >= 0 AND risk_percent <= 100 GROUP BY 1),
f AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1})),
e AS (SELECT bin, CASE bin {lo} END AS bin_lo, CASE bin {hi} END AS bin_hi FROM f)
SELECT e.bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round((bin_lo + bin_hi) / 2, 6) AS center, {band_sql('(bin_lo + bin_hi) / 2', 30.0, 60.0)} AS band
FROM e LEFT JOIN c ON e.bin = c.bin"""


@register("score_histogram", _hist_sql())
def q_score_histogram(spark, sf):
    return round_doubles(stats.histogram(hist_h(spark, sf), "risk_percent"))


_BOX_SQL = f"""
WITH q AS (SELECT risk_band, CAST(count(*) AS BIGINT) AS n,
    quantile_cont(risk_percent, 0.25) AS q1, quantile_cont(risk_percent, 0.5) AS median,
    quantile_cont(risk_percent, 0.75) AS q3 FROM {HS} h GROUP BY risk_band),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
a AS (SELECT h.risk_band,
    min(CASE WHEN risk_percent >= lower_fence AND risk_percent <= upper_fence THEN risk_percent END) AS whisker_lo,
    max(CASE WHEN risk_percent >= lower_fence AND risk_percent <= upper_fence THEN risk_percent END) AS whisker_hi,
    CAST(sum(CASE WHEN risk_percent >= lower_fence AND risk_percent <= upper_fence THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
    min(risk_percent) AS min, max(risk_percent) AS max, avg(risk_percent) AS mean, stddev_samp(risk_percent) AS sd
  FROM {HS} h JOIN f ON h.risk_band = f.risk_band GROUP BY h.risk_band)"""


@register("band_box_stats", _BOX_SQL + """
SELECT f.risk_band, f.n, round(a.min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(a.max, 6) AS max, round(iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence,
  round(upper_fence, 6) AS upper_fence, round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi,
  n_outliers, round(mean, 6) AS mean, round(sd, 6) AS sd
FROM f JOIN a ON f.risk_band = a.risk_band""")
def q_band_box_stats(spark, sf):
    return round_doubles(stats.box_stats(hist_h(spark, sf), "risk_percent", "risk_band",
                                         max_groups=len(BAND_NAMES)))


@register("band_outliers", _BOX_SQL + f"""
SELECT h.record_id, h.risk_band, round(h.risk_percent, 6) AS risk_percent,
  round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence
FROM {HS} h JOIN f ON h.risk_band = f.risk_band
WHERE h.risk_percent < lower_fence OR h.risk_percent > upper_fence""")
def q_band_outliers(spark, sf):
    return round_doubles(stats.outliers(hist_h(spark, sf), "record_id", "risk_percent", "risk_band",
                                        max_groups=len(BAND_NAMES)))


@register("band_density", _BOX_SQL + f""",
p AS (SELECT f.risk_band, f.n, a.min, a.max,
    0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.349) ELSE sd END * pow(CAST(f.n AS DOUBLE), -0.2) AS bw
  FROM f JOIN a ON f.risk_band = a.risk_band),
g AS (SELECT p.*, CAST(range AS INTEGER) AS k, p.min + range * (p.max - p.min) / CAST(49 AS DOUBLE) AS x
      FROM p, range(0, 50) WHERE bw > 0)
SELECT g.risk_band, g.k, round(g.x, 6) AS x,
  round(sum(exp(-0.5 * ((g.x - h.risk_percent) / bw) * ((g.x - h.risk_percent) / bw)) / (bw * sqrt(2 * pi()))) / max(g.n), 6) AS density
FROM g JOIN {HS} h ON g.risk_band = h.risk_band GROUP BY g.risk_band, g.k, g.x""")
def q_band_density(spark, sf):
    return round_doubles(stats.density(hist_h(spark, sf), "risk_percent", "risk_band", 50,
                                       max_groups=len(BAND_NAMES)))


@register("trend_fit", f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(regr_slope(probability, entity_id), 6) AS slope,
  round(regr_intercept(probability, entity_id), 6) AS intercept,
  round(CAST(min(entity_id) AS DOUBLE), 6) AS x_min, round(CAST(max(entity_id) AS DOUBLE), 6) AS x_max
FROM {H} h HAVING count(*) >= 2""")
def q_trend_fit(spark, sf):
    return round_doubles(stats.trend_fit(history_view(spark, sf), "entity_id", "probability"))


@register("trend_line", f"""
WITH f AS (SELECT regr_slope(probability, entity_id) AS slope, regr_intercept(probability, entity_id) AS intercept,
    CAST(min(entity_id) AS DOUBLE) AS x_min, CAST(max(entity_id) AS DOUBLE) AS x_max FROM {H} h HAVING count(*) >= 2),
p AS (SELECT CAST(range AS INTEGER) AS k, CASE WHEN range = 99 THEN x_max
      ELSE x_min + range * ((x_max - x_min) / CAST(99 AS DOUBLE)) END AS x, slope, intercept FROM f, range(0, 100))
SELECT k, round(x, 6) AS x, round(slope * x + intercept, 6) AS y FROM p""")
def q_trend_line(spark, sf):
    return round_doubles(stats.trend_line(history_view(spark, sf), "entity_id", "probability", 100))


@register("latest_score", f"""
SELECT record_id, timestamp, round(risk_percent, 6) AS risk_percent, risk_band
FROM {HS} h ORDER BY timestamp DESC, record_id DESC LIMIT 1""")
def q_latest_score(spark, sf):
    return round_doubles(stats.latest_score(history_view(spark, sf)))


_GUIDE_SQL = "CASE " + " ".join(f"WHEN risk_band = '{b}' THEN '{t}'" for b, t in BAND_GUIDANCE.items()) + " END"


@register("confidence", f"""
SELECT record_id, round(risk_percent, 6) AS risk_percent,
  round(greatest(risk_percent, 100 - risk_percent), 6) AS confidence, risk_band, {_GUIDE_SQL} AS guidance
FROM {HS} h""")
def q_confidence(spark, sf):
    h = hist_h(spark, sf)
    return round_doubles(h.select("record_id", "risk_percent", confidence("risk_percent").alias("confidence"),
                                  "risk_band", guidance("risk_band").alias("guidance")))


@register("records_table", f"""
SELECT record_id, strftime(timestamp, '%b %d %Y, %H:%M') AS display_time,
  round(risk_percent, 6) AS risk_percent, risk_band, model_used
FROM {HS} h""")
def q_records_table(spark, sf):
    h = hist_h(spark, sf)
    # The numeric percent is the canonical column; pct_text() is presentation only.
    return round_doubles(h.select("record_id", display_time("timestamp").alias("display_time"),
                                  "risk_percent", "risk_band", "model_used"))


# --------------------------------------------------------------------------- H: normalise

def _legacy_events(spark, sf):
    """Legacy nested records over ``events``: features inside ``input_data`` parsed from the
    JSON text, a conflicting top-level value, a store key, and no model on error rows."""
    ev = read_table(spark, sf, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("_id"),
        F.col("event_id").alias("record_id"),
        F.from_json("props", "k double").alias("input_data"),
        F.col("value").alias("k"),
        F.when(F.col("event_type") != F.lit("error"), F.col("event_type")).alias("model_used"))


@register("flatten_nested", f"""
SELECT event_id AS record_id,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), value) AS k,
  coalesce(CASE WHEN event_type <> 'error' THEN event_type END, '{UNKNOWN_MODEL}') AS model_used
FROM events""")
def q_flatten_nested(spark, sf):
    return history.flatten_nested(_legacy_events(spark, sf), keys=[]).select("record_id", "k", "model_used")


@register("timestamp_roundtrip", """
WITH t AS (SELECT event_id AS record_id, ts,
  CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events)
SELECT record_id, iso, CAST(iso AS TIMESTAMP) = ts AS roundtrip_ok FROM t""")
def q_timestamp_roundtrip(spark, sf):
    ev = read_table(spark, sf, "events")
    t = ev.select(F.col("event_id").alias("record_id"), "ts", iso_text("ts").alias("iso"))
    return t.select("record_id", "iso", (parse_iso("iso") == F.col("ts")).alias("roundtrip_ok"))


@register("history_union", f"""
SELECT record_id, timestamp, model_used, entity_id, round(probability, 6) AS probability, source FROM (
  SELECT event_id AS record_id, ts AS timestamp, event_type AS model_used, user_id AS entity_id,
    least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS probability, 'primary' AS source
  FROM events WHERE event_type <> 'error'
  UNION ALL BY NAME
  SELECT event_id AS record_id, ts AS timestamp, '{UNKNOWN_MODEL}' AS model_used,
    least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS probability, 'fallback' AS source
  FROM events WHERE event_type = 'error') u""")
def q_history_union(spark, sf):
    h = history_view(spark, sf)
    primary = h.where(F.col("model_used") != F.lit("error"))
    fallback = h.where(F.col("model_used") == F.lit("error")).select("record_id", "timestamp", "probability")
    u = history.union_history(primary, fallback)
    return round_doubles(u.select("record_id", "timestamp", "model_used", "entity_id", "probability", "source"))


# --------------------------------------------------------------------------- validation

L_RULES = [("l_quantity", 1.0, 50.0, None), ("l_discount", 0.0, 0.1, None),
           ("l_tax", 0.0, 0.08, None), ("l_extendedprice", 0.0, None, None)]


def _rules_sql() -> str:
    parts = []
    conds = []
    for col, lo, hi, _ in L_RULES:
        bad = " OR ".join(x for x in [f"{col} < {_dbl(lo)}" if lo is not None else "",
                                       f"{col} > {_dbl(hi)}" if hi is not None else ""] if x)
        conds.append(f"({col} IS NOT NULL AND ({bad}))")
        parts.append(f"SELECT '{col}' AS rule, CAST(count({col}) AS BIGINT) AS n_checked, "
                     f"CAST(sum(CASE WHEN {col} IS NOT NULL AND ({bad}) THEN 1 ELSE 0 END) AS BIGINT) AS n_violations FROM l")
    parts.append(f"SELECT '*any*' AS rule, CAST(count(*) AS BIGINT) AS n_checked, "
                 f"CAST(sum(CASE WHEN {' OR '.join(conds)} THEN 1 ELSE 0 END) AS BIGINT) AS n_violations FROM l")
    return f"WITH l AS {L} " + " UNION ALL ".join(parts)


@register("domain_violations", _rules_sql())
def q_domain_violations(spark, sf):
    return validate.violation_counts(labelled_view(spark, sf), L_RULES)


def _requests(spark, sf):
    """Score requests as text over ``events``: error rows carry a non-numeric value."""
    ev = read_table(spark, sf, "events")
    return ev.select(
        F.col("event_id").alias("record_id"),
        F.when(F.col("event_type") == F.lit("error"), F.lit("n/a"))
         .otherwise(F.col("value").cast("string")).alias("value"),
        F.get_json_object("props", "$.k").alias("k"),
        F.col("user_id").cast("string").alias("user"))


@register("request_quarantine", """
WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
    json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS "user" FROM events),
c AS (SELECT TRY_CAST(value AS DOUBLE) IS NULL AS b1, TRY_CAST(k AS DOUBLE) IS NULL AS b2,
    TRY_CAST("user" AS DOUBLE) IS NULL AS b3 FROM r)
SELECT CAST(count(*) AS BIGINT) AS n_total,
  CAST(sum(CASE WHEN b1 OR b2 OR b3 THEN 0 ELSE 1 END) AS BIGINT) AS n_valid,
  CAST(sum(CASE WHEN b1 OR b2 OR b3 THEN 1 ELSE 0 END) AS BIGINT) AS n_quarantined,
  CAST(sum(CASE WHEN b1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_value,
  CAST(sum(CASE WHEN b2 THEN 1 ELSE 0 END) AS BIGINT) AS bad_k,
  CAST(sum(CASE WHEN b3 THEN 1 ELSE 0 END) AS BIGINT) AS bad_user FROM c""")
def q_request_quarantine(spark, sf):
    q = validate.quarantine(_requests(spark, sf), ["value", "k", "user"])
    return q.agg(F.count(F.lit(1)).alias("n_total"), F.count_if("valid").alias("n_valid"),
                 F.count_if(~F.col("valid")).alias("n_quarantined"),
                 F.count_if(F.array_contains("bad_features", "value")).alias("bad_value"),
                 F.count_if(F.array_contains("bad_features", "k")).alias("bad_k"),
                 F.count_if(F.array_contains("bad_features", "user")).alias("bad_user"))


_CLASS_SQL = " UNION ALL ".join(f"SELECT {c} AS code, '{n}' AS class_name" for c, n in CLASS_NAMES)


@register("code_decode", f"""
SELECT l.label, t.class_name, CAST(count(*) AS BIGINT) AS n
FROM {L} l LEFT JOIN ({_CLASS_SQL}) t ON l.label = t.code GROUP BY l.label, t.class_name""")
def q_code_decode(spark, sf):
    d = validate.decode(labelled_view(spark, sf), "label", CLASS_NAMES, "class_name")
    return d.groupBy("label", "class_name").agg(F.count(F.lit(1)).alias("n"))


_KEYS_SQL = ", ".join(f"'{k}'" for k in MODEL_KEYS)
_COLOR_SQL = " UNION ALL ".join(f"SELECT '{k}' AS key, '{c}' AS color" for k, c in MODEL_COLORS)


@register("model_key_fallback", f"""
WITH m AS (SELECT model_used AS requested,
    CASE WHEN model_used IN ({_KEYS_SQL}) THEN model_used ELSE '{DEFAULT_MODEL}' END AS chosen FROM {H} h)
SELECT requested, chosen,
  array_to_string(list_transform(string_split(replace(chosen, '_', ' '), ' '),
                  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display_name,
  coalesce(c.color, '{DEFAULT_MODEL_COLOR}') AS color, CAST(count(*) AS BIGINT) AS n
FROM m LEFT JOIN ({_COLOR_SQL}) c ON m.chosen = c.key GROUP BY ALL""")
def q_model_key_fallback(spark, sf):
    h = history_view(spark, sf).select(F.col("model_used").alias("requested"))
    m = h.withColumn("chosen", validate.choose_model("requested"))
    m = validate.decode(m, "chosen", MODEL_COLORS, "color", DEFAULT_MODEL_COLOR, key_type="string")
    return (m.withColumn("display_name", key_to_display("chosen"))
            .groupBy("requested", "chosen", "display_name", "color").agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------- L: cleaning

def _holed(spark, sf):
    """L with missing values: zero discounts/taxes become holes, and discount passes through
    text with the ``?`` marker, as the training CSV does."""
    l = labelled_view(spark, sf)
    disc_text = F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)).cast("string"), F.lit("?"))
    return (l.withColumn("l_discount", disc_text)
            .withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0))))


_HOLED_SQL = (f"(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
              f"nullif(l_discount, CAST(0 AS DOUBLE)) AS l_discount, nullif(l_tax, CAST(0 AS DOUBLE)) AS l_tax, "
              f"label FROM {L} l0)")
_HOLED_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "label"]


@register("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_null, count({c}) > 0 AS has_values "
    f"FROM {_HOLED_SQL} x" for c in _HOLED_COLS))
def q_null_profile(spark, sf):
    d = clean.coerce_numeric(_holed(spark, sf), ["l_discount"], strict=True)
    return clean.null_profile(d, _HOLED_COLS)


@register("median_impute", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(coalesce(l_discount, (SELECT median(l_discount) FROM {_HOLED_SQL} a)), 6) AS l_discount,
  round(coalesce(l_tax, (SELECT median(l_tax) FROM {_HOLED_SQL} b)), 6) AS l_tax
FROM {_HOLED_SQL} x""")
def q_median_impute(spark, sf):
    d = clean.coerce_numeric(_holed(spark, sf), ["l_discount"], strict=True)
    out = clean.median_impute(d, ["l_discount", "l_tax"])
    return round_doubles(out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"))


@register("binarize_label", """
SELECT vec_id, label, CASE WHEN label > 0 THEN 1 ELSE 0 END AS target FROM embeddings""")
def q_binarize_label(spark, sf):
    from ..functions.coerce import binarize
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", binarize("label").alias("target"))


@register("standard_scale", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS z_{c}" for c in L_FEATURES)
    + f" FROM {L} l")
def q_standard_scale(spark, sf):
    from ..operators import ml
    l = labelled_view(spark, sf)
    scaler = ml.fit_population_scaler(l, L_FEATURES)
    z = ml.apply_scaler(l, scaler, prefix="z_")
    return round_doubles(z.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                  *[f"z_{c}" for c in L_FEATURES]))


_CORR_COLS = L_FEATURES + ["label"]


@register("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r "
    f"FROM {L} l" for a in _CORR_COLS for b in _CORR_COLS))
def q_corr_matrix(spark, sf):
    return round_doubles(stats.corr_matrix(labelled_view(spark, sf), _CORR_COLS))


_SPLIT_SQL = "(l_orderkey * 7 + l_linenumber * 13 + l_partkey * 31 + l_suppkey) % 100 < 20"


@register("hash_split", f"""
SELECT CASE WHEN {_SPLIT_SQL} THEN 'test' ELSE 'train' END AS split, label, CAST(count(*) AS BIGINT) AS n
FROM {L} l GROUP BY ALL""")
def q_hash_split(spark, sf):
    from ..operators import ml
    l = labelled_view(spark, sf)
    key = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey") * 31 + F.col("l_suppkey"))
    s = ml.deterministic_split(l, key_expr=key)
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- ordered

@register("rolling_mean", f"""
WITH c AS (SELECT greatest(1, count(*) // {ROLLING_DIVISOR}) AS w FROM events),
h AS (SELECT record_id, CAST(round(probability * 10000) AS BIGINT) AS risk_bp,
    row_number() OVER (ORDER BY timestamp, record_id) AS row_index FROM {H} h0),
p AS (SELECT *, sum(risk_bp) OVER (ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS s,
    count(risk_bp) OVER (ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS cn FROM h)
SELECT a.record_id, CAST(a.row_index AS BIGINT) AS row_index, a.risk_bp,
  ((a.s - coalesce(b.s, 0)) / (a.cn - coalesce(b.cn, 0))) / CAST(100 AS DOUBLE) AS rolling_mean,
  CAST(c.w AS INTEGER) AS window_rows
FROM p a CROSS JOIN c LEFT JOIN p b ON b.row_index = a.row_index - c.w""")
def q_rolling_mean(spark, sf):
    # The score in hundredths of a percent is an exact integer, so running sums are exact
    # and the mean is one IEEE division - bit-identical in any engine (no rounding needed).
    h = history_view(spark, sf).select(
        "record_id", "timestamp", F.round(F.col("probability") * 10000).cast("long").alias("risk_bp"))
    r = ordered.rolling_mean(h, "risk_bp", ["timestamp", "record_id"], divisor=ROLLING_DIVISOR)
    return r.select("record_id", F.col("row_index").cast("long").alias("row_index"), "risk_bp",
                    (F.col("rolling_mean") / F.lit(100.0)).alias("rolling_mean"),
                    F.col("window_rows").cast("int").alias("window_rows"))


@register("global_row_index", f"""
SELECT record_id, CAST(row_number() OVER (ORDER BY timestamp, record_id) AS BIGINT) AS row_index FROM {H} h""")
def q_global_row_index(spark, sf):
    h = history_view(spark, sf).select("record_id", "timestamp")
    r = ordered.global_row_index(h, ["timestamp", "record_id"])
    return r.select("record_id", F.col("row_index").cast("long").alias("row_index"))


# --------------------------------------------------------------------------- L: scoring and evaluation

# Fixed logistic coefficients (intercept, then one per L feature) for the scoring query.
LOGIT_INTERCEPT = -1.5
LOGIT_COEF = [0.04, -0.00001, 2.0, -3.0]


@register("logistic_score_fixed", f"""
WITH z AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    1 / (1 + exp(-({_dbl(LOGIT_INTERCEPT)} + """ + " + ".join(
        f"{_dbl(b)} * {c}" for b, c in zip(LOGIT_COEF, L_FEATURES)) + f"""))) AS p FROM {L} l)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(p, 6) AS probability,
  CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, 'logistic_regression' AS model_used FROM z""")
def q_logistic_score_fixed(spark, sf):
    l = labelled_view(spark, sf)
    z = F.lit(LOGIT_INTERCEPT)
    for b, c in zip(LOGIT_COEF, L_FEATURES):
        z = z + F.lit(b) * F.col(c)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    out = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", p.alias("probability"))
    out = out.withColumn("prediction", (F.col("probability") > F.lit(0.5)).cast("int")) \
             .withColumn("model_used", F.lit("logistic_regression"))
    return round_doubles(out)


_PRED = "CASE WHEN score > 0.5 THEN 1 ELSE 0 END"


def _l_pred(spark, sf):
    return labelled_view(spark, sf).withColumn("prediction", (F.col("score") > F.lit(0.5)).cast("int"))


@register("confusion_matrix", f"""
WITH c AS (SELECT label AS actual, {_PRED} AS predicted, count(*) AS n FROM {L} l GROUP BY ALL),
cells AS (SELECT a AS actual, p AS predicted FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, p))
SELECT CAST(cells.actual AS INTEGER) AS actual, CAST(cells.predicted AS INTEGER) AS predicted,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM cells LEFT JOIN c ON cells.actual = c.actual AND cells.predicted = c.predicted""")
def q_confusion_matrix(spark, sf):
    return evaluate.confusion(_l_pred(spark, sf), "label", "prediction")


@register("classification_metrics", f"""
WITH c AS (SELECT CAST(count(*) AS BIGINT) AS n,
    CAST(sum(CASE WHEN label = 1 AND {_PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN label = 0 AND {_PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND {_PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 0 AND {_PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM {L} l)
SELECT n, tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(CAST(n AS DOUBLE), 0), 0), 6) AS accuracy,
  round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1_score FROM c""")
def q_classification_metrics(spark, sf):
    return round_doubles(evaluate.classification_metrics(_l_pred(spark, sf), "label", "prediction"))


_ROC_SQL = f"""
WITH g AS (SELECT score, CAST(sum(label) AS BIGINT) AS tp, CAST(count(*) - sum(label) AS BIGINT) AS fp
           FROM {L} l GROUP BY score),
t AS (SELECT sum(tp) AS n_pos, sum(fp) AS n_neg FROM g),
c AS (SELECT score, tp, fp, row_number() OVER (ORDER BY score DESC) AS point,
    sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
    sum(fp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_fp FROM g)"""


@register("roc_points", _ROC_SQL + """
SELECT CAST(0 AS BIGINT) AS point, CAST(NULL AS DOUBLE) AS threshold,
  CASE WHEN n_neg > 0 THEN CAST(0 AS DOUBLE) END AS fpr, CASE WHEN n_pos > 0 THEN CAST(0 AS DOUBLE) END AS tpr FROM t
UNION ALL
SELECT CAST(point AS BIGINT), round(score, 6), round(cum_fp / nullif(CAST(n_neg AS DOUBLE), 0), 6),
  round(cum_tp / nullif(CAST(n_pos AS DOUBLE), 0), 6) FROM c, t""")
def q_roc_points(spark, sf):
    return round_doubles(evaluate.roc_points(labelled_view(spark, sf), "score", "label"))


@register("roc_auc", _ROC_SQL + """
SELECT round(sum(fp * (2.0 * cum_tp - tp)) / nullif(2.0 * max(n_pos) * max(n_neg), 0), 6) AS roc_auc FROM c, t""")
def q_roc_auc(spark, sf):
    return round_doubles(evaluate.roc_auc(labelled_view(spark, sf), "score", "label"))


# Three fixed score columns stand for three models (name, SQL / Spark expression).
MODEL_SCORES = [("Logistic Regression", "score"),
                ("Random Forest", "l_discount * 10"),
                ("Gradient Boosting", "1 - l_tax * 10")]


def _tall_scores(spark, sf):
    l = labelled_view(spark, sf)
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("model"), F.expr(e).alias("score"))
                    for i, (n, e) in enumerate(MODEL_SCORES)])
    return l.select("label", F.explode(arr).alias("m")).select("m.position", "m.model", "label", "m.score")


_TALL_SQL = f"(" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{n}' AS model, label, {e} AS score FROM {L} l" for i, (n, e) in enumerate(MODEL_SCORES)) + ")"
_CMP_SQL = f"""
WITH s AS {_TALL_SQL},
g AS (SELECT position, model, score, sum(label) AS tp, count(*) - sum(label) AS fp FROM s GROUP BY ALL),
t AS (SELECT model, sum(tp) AS n_pos, sum(fp) AS n_neg FROM g GROUP BY model),
c AS (SELECT g.*, sum(tp) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp FROM g),
auc AS (SELECT c.model, sum(fp * (2.0 * cum_tp - tp)) / nullif(2.0 * max(n_pos) * max(n_neg), 0) AS roc_auc
        FROM c JOIN t ON c.model = t.model GROUP BY c.model),
acc AS (SELECT position, model, avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM s GROUP BY position, model),
cmp AS (SELECT acc.position, acc.model, acc.accuracy, auc.roc_auc FROM acc JOIN auc ON acc.model = auc.model)"""


def _comparison(spark, sf):
    return evaluate.compare_models(_tall_scores(spark, sf), "model", "score", "label") \
        .join(_positions(spark), "model")


def _positions(spark):
    return spark.createDataFrame([(n, i) for i, (n, _) in enumerate(MODEL_SCORES)], "model string, position int")


@register("model_comparison", _CMP_SQL + """
SELECT model, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc FROM cmp""")
def q_model_comparison(spark, sf):
    return round_doubles(_comparison(spark, sf).select("model", "accuracy", "roc_auc"))


@register("best_model", _CMP_SQL + """
SELECT model, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc FROM cmp
ORDER BY accuracy DESC, position ASC LIMIT 1""")
def q_best_model(spark, sf):
    b = evaluate.best_model(_comparison(spark, sf), "accuracy", "model", "position")
    return round_doubles(b.select("model", "accuracy", "roc_auc"))


@register("rank_models", _CMP_SQL + """
SELECT CAST(row_number() OVER (ORDER BY roc_auc DESC, model ASC) AS INTEGER) AS rank, model,
  round(roc_auc, 6) AS roc_auc, round(roc_auc * 100 / max(roc_auc) OVER (), 6) AS pct_of_max,
  '#' || CAST(row_number() OVER (ORDER BY roc_auc DESC, model ASC) AS VARCHAR) AS rank_label FROM cmp""")
def q_rank_models(spark, sf):
    r = evaluate.rank_models(_comparison(spark, sf).select("model", "roc_auc"), "roc_auc", "model")
    return round_doubles(r.select(F.col("rank").cast("int").alias("rank"), "model", "roc_auc", "pct_of_max",
                                  "rank_label"))


@register("importance_scaled", f"""
WITH i AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(covar_pop({c}, label) / nullif(stddev_pop({c}) * stddev_pop(label), 0)) AS importance FROM {L} l"
    for c in L_FEATURES) + """),
n AS (SELECT feature, importance, (importance - min(importance) OVER ()) /
        (max(importance) OVER () - min(importance) OVER () + 1e-9) AS norm FROM i)
SELECT feature, round(importance, 6) AS importance, round(norm, 6) AS norm, round(0.3 + 0.65 * norm, 6) AS shade,
  CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM n""")
def q_importance_scaled(spark, sf):
    from pyspark.sql import Window
    from ..operators import ml
    c = stats.corr_matrix(labelled_view(spark, sf), L_FEATURES + ["label"],
                          pairs=[(f, "label") for f in L_FEATURES])
    imp = c.select(F.col("x").alias("feature"), F.abs(F.col("r")).alias("importance"))  # P33
    s = ml.minmax_shade(imp, "importance")
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), F.asc("feature"))).cast("int"))
    return round_doubles(s.select("feature", "importance", "norm", "shade", "rank"))


# --------------------------------------------------------------------------- streaming

@register("stream_daily_kpis", """
WITH h AS (SELECT ts, least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS probability FROM events),
d AS (SELECT date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS total,
    CAST(sum(CASE WHEN probability < CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS low_n,
    CAST(sum(CASE WHEN probability >= CAST(0.3 AS DOUBLE) AND probability < CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS moderate_n,
    CAST(sum(CASE WHEN probability >= CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS high_n,
    CAST(sum(CASE WHEN probability * CAST(100 AS DOUBLE) > CAST(60 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS over_60_n,
    round(avg(probability), 6) AS avg_probability FROM h GROUP BY 1)
SELECT * FROM d WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)""")
def q_stream_daily_kpis(spark, sf):
    from ..streaming.jobs import stream_daily_kpis
    return round_doubles(stream_daily_kpis(spark, sf, glob="events.parquet"))


@register("stream_trend", """
WITH h AS (SELECT ts, least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(100 AS DOUBLE) AS rp FROM events),
e AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS ws, rp FROM h, range(0, 7) t(k)),
g AS (SELECT ws AS window_start, ws + INTERVAL 7 DAY AS window_end, round(avg(rp), 6) AS mean_risk_percent,
    CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ws)
SELECT * FROM g WHERE window_end + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def q_stream_trend(spark, sf):
    from ..streaming.jobs import stream_trend
    return round_doubles(stream_trend(spark, sf, glob="events.parquet"))


# --------------------------------------------------------------------------- ML (rows-only)

_TRAINED: dict = {}
EMB_DIM = 64
EMB_FEATURES = [f"f{i}" for i in range(EMB_DIM)]


def learnable_view(spark, sf):
    """The learnable training set: ``embeddings`` with its 64 floats as feature columns and
    ``label > 0`` as the binary target (P4), like the 0-4 severity -> 0/1 target."""
    from ..functions.coerce import binarize
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", binarize("label").alias("target"),
                    *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(EMB_FEATURES)])


def _trained(spark, sf):
    """Fit the three candidates once per session and table (M1, M3-M5, M9): population-sd
    scaling fitted on the train split, then the three pipelines."""
    from ..operators import ml
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = ml.train_and_compare(learnable_view(spark, sf), EMB_FEATURES, "target",
                                             key_cols=["vec_id"])
    return _TRAINED[key]


@register("train_compare")
def q_train_compare(spark, sf):
    results, _, best = _trained(spark, sf)
    return results.withColumn("is_best", F.col("model") == F.lit(best))


@register("feature_importance")
def q_feature_importance(spark, sf):
    from ..operators import ml
    _, models, _ = _trained(spark, sf)
    return ml.importance_table(models, EMB_FEATURES, spark)


@register("score_batch")
def q_score_batch(spark, sf):
    """M8 + P24 + P25 + P31: requests with 64 features as text, a few of them missing or no numbers.
    Bad rows are rejected (``bad_features`` names why) before any model sees them; the others are
    scored by the model they name (an unknown key falls back to the default) with the saved and
    reloaded pipelines and stamped with the model's artefact digest."""
    from ..operators import ml
    from ..sources.artifacts import artifact_manifest, load_models, save_models
    from ..operators.staged import Staged
    from ..session import shared_dir
    import uuid
    _, models, _ = _trained(spark, sf)
    root = shared_dir(spark, f"riskspark-models-{uuid.uuid4().hex}")
    save_models(spark, {ml.model_key(n): m for n, m in models.items()}, root)
    loaded = load_models(spark, [ml.model_key(n) for n in models], root)
    requests = learnable_view(spark, sf).select(
        "vec_id", "target",
        F.when(F.col("label") <= 3, F.lit("logistic_regression"))
         .when(F.col("label") <= 6, F.lit("gradient_boosting")).otherwise(F.lit("svm")).alias("requested"),
        F.when(F.col("label") == 9, F.lit("n/a")).otherwise(F.col("f0").cast("string")).alias("f0"),
        F.when(F.col("f1") < 0.15, F.col("f1")).cast("string").alias("f1"),
        *[F.col(f).cast("string") for f in EMB_FEATURES[2:]])
    good, bad = validate.staged_requests(requests, EMB_FEATURES, Staged(spark, "requests"))
    out = ml.score_by_model(loaded, good.withColumn("model_used", validate.choose_model("requested")))
    manifest = artifact_manifest(spark, root, list(loaded)).select(
        F.col("model").alias("model_used"), F.col("sha256").alias("model_hash"))
    from ..operators.joins import broadcast_if_small
    out = out.join(broadcast_if_small(manifest, known_rows=len(loaded)), "model_used", "left")
    keep = ["vec_id", "target", "requested", "model_used", "prediction", "probability", "model_hash", "bad_features"]
    return out.withColumn("bad_features", F.array().cast("array<string>")).select(*keep).unionByName(
        bad.select("vec_id", "target", "requested", "bad_features"), allowMissingColumns=True)


@register("artifact_manifest")
def q_artifact_manifest(spark, sf):
    from ..operators import ml
    from ..sources.artifacts import artifact_manifest, save_models
    from ..session import shared_dir
    import uuid
    _, models, _ = _trained(spark, sf)
    root = shared_dir(spark, f"riskspark-models-{uuid.uuid4().hex}")
    save_models(spark, {ml.model_key(n): m for n, m in models.items()}, root)
    return artifact_manifest(spark, root, [ml.model_key(n) for n in models] + ["heart_model"])


@register("io_roundtrip")
def q_io_roundtrip(spark, sf):
    """Every source and sink once over the history and labelled tables (S1-S3, S5, S6, S9,
    K1-K6, K8); returns the row count seen at each step."""
    import uuid
    from ..session import shared_dir
    from ..sources import files, sinks
    from ..schemas import SCORE_RECORD_SCHEMA, TRAINING_SCHEMA
    root = shared_dir(spark, f"riskspark-io-{uuid.uuid4().hex}")
    h = history_view(spark, sf).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    counts = []
    sinks.append_history(h, f"{root}/history")                                   # K1
    stored = sinks.append_with_fallback(h, {"path": f"{root}/store", "fmt": "unreachable_store"},  # K3
                                        {"path": f"{root}/fallback"})
    assert stored.reason
    back = files.read_history(spark, f"{root}/history")                         # S3
    counts.append(("history_parquet", back.count()))
    counts.append((f"failover_{stored}", files.read_history(spark, f"{root}/fallback").count()))
    sinks.export_history(back.drop("score_date"), f"{root}/history_json")        # K8
    j = files.read_history_json(spark, f"{root}/history_json",
                                back.drop("score_date").schema)                 # S2
    counts.append(("history_json", j.count()))
    counts.append(("missing_json", files.read_history_json(spark, f"{root}/nope", SCORE_RECORD_SCHEMA).count()))
    # Training CSV with '?' markers, written from L (label as target 0..1).
    l = labelled_view(spark, sf)
    csv = l.select(*[F.coalesce(F.nullif(F.col(c), F.lit(0.0)).cast("string"), F.lit("?")).alias(c)
                     for c in L_FEATURES], F.col("label").cast("string"))
    csv.write.mode("overwrite").option("header", False).csv(f"{root}/training_csv")
    schema = "l_quantity double, l_extendedprice double, l_discount double, l_tax double, target double"
    t = files.read_training(spark, f"{root}/training_csv", schema=spark.createDataFrame([], schema).schema)  # S1
    counts.append(("training_csv", t.count()))
    auc = evaluate.roc_auc(labelled_view(spark, sf), "score", "label").first()["roc_auc"]  # one number
    m = evaluate.classification_metrics(_l_pred(spark, sf)).select("accuracy", "precision", "recall", "f1_score") \
        .withColumn("roc_auc", F.lit(auc).cast("double"))
    sinks.write_metrics(m, f"{root}/metrics")                                    # K4
    counts.append(("metrics", files.read_metrics(spark, f"{root}/metrics").count()))  # S5
    cmp_rows = [(r["model"], r["accuracy"], r["roc_auc"]) for r in _comparison(spark, sf).collect()]
    sinks.write_comparison(cmp_rows, spark, f"{root}/comparison")                # K5
    counts.append(("comparison", files.read_comparison(spark, f"{root}/comparison").count()))  # S6
    sinks.write_confusion(evaluate.confusion(_l_pred(spark, sf)), f"{root}/confusion")  # K6
    counts.append(("confusion", files.read_confusion(spark, f"{root}/confusion").count()))  # S9
    return spark.createDataFrame(counts, "step string, n long")


from . import service  # noqa: E402,F401  more queries, registered in the same tables
