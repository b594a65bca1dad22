"""Request validation and code lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_MODEL, MODEL_KEYS
from .joins import broadcast_if_small
from .staged import Staged


def choose_model(col, allowed: list[str] | None = None, default: str = DEFAULT_MODEL):
    """Unknown or absent model key -> the default model."""
    allowed = allowed or MODEL_KEYS
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def _numbers(df: DataFrame, feature_cols: list[str], nan_ok: bool) -> DataFrame:
    """``df`` with ``_nums`` (per feature its name and its ``num``, NULL where ``try_cast`` fails) and
    ``bad_features``. Functions over one array: the plan does not grow with the features. Name and
    number go together, so ``bad_features`` reads ``_nums`` once: a filter on it that Spark pushes
    below this step converts every feature once, not all of them again for each feature."""
    texts = F.array(*[F.col(c).cast("string") for c in feature_cols])
    names = F.array(*[F.lit(c) for c in feature_cols])
    out = df.withColumn("_nums", F.transform(texts, lambda t, k: F.struct(names[k].alias("name"), t.try_cast("double").alias("num"))))
    bad = lambda x: x["num"].isNull() if nan_ok else x["num"].isNull() | F.isnan(x["num"])
    return out.withColumn("bad_features", F.transform(F.filter("_nums", bad), lambda x: x["name"]))


def quarantine(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """P6 + P25: coerce every feature with ``try_cast``; ``bad_features`` lists the ones
    that are missing or not numeric and ``valid`` says whether the row can be scored.
    Split with ``where(valid)`` / ``where(~valid)`` - no exception kills the batch."""
    q = _numbers(df, feature_cols, nan_ok=True)
    return q.select(*df.columns, *[F.col("_nums")[k]["num"].alias(f"{c}_num") for k, c in enumerate(feature_cols)],
                    "bad_features", (F.size("bad_features") == F.lit(0)).alias("valid"))


def split_requests(df: DataFrame, feature_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """P25 in front of scoring: (rows that can be scored, their features as doubles; rejected
    rows as they came, with ``bad_features``). NaN counts as not numeric here: no model scores it.
    A feature that is no column at all is missing in every row."""
    absent = [c for c in feature_cols if c not in df.columns]
    q = _numbers(df.withColumns({c: F.lit(None).cast("string") for c in absent}), feature_cols, nan_ok=False)
    good = F.size("bad_features") == 0
    at = {c: k for k, c in enumerate(feature_cols)}
    return (q.where(good).select(*[F.col("_nums")[at[c]]["num"].alias(c) if c in at else F.col(c) for c in [*df.columns, *absent]]),
            q.where(~good).select(*df.columns, "bad_features"))


def staged_requests(df: DataFrame, feature_cols: list[str], stage: Staged, name: str = "requests") -> tuple[DataFrame, DataFrame]:
    """:func:`split_requests` with the conversion done once: every row is written with its numbers (or, when
    it is rejected, as it came), ``bad_features`` and whether it is good, and both frames read that table. Each
    model's pass is then a scan. No filter stands on the conversion itself: one over many features makes Spark's
    constraints double with every feature, and planning never ends. Conversion and test are plain columns that
    Spark compiles; only rejected rows go through a function over their features, to name the bad ones."""
    absent = [c for c in feature_cols if c not in df.columns]
    at = {c: k for k, c in enumerate(feature_cols)}
    nums = F.array(*[F.col(c).cast("string").try_cast("double") for c in feature_cols])
    # NULL for a row with a NULL and without NaN: not good either.
    good = F.coalesce(~F.array_contains("_nums", F.lit(float("nan"))), F.lit(False))
    q = df.withColumns({c: F.lit(None).cast("string") for c in absent}).withColumn("_nums", nums).withColumn("_good", good)
    num = lambda k: F.col("_nums")[k]
    named = F.array(*[F.when(num(k).isNull() | F.isnan(num(k)), F.lit(c)) for c, k in at.items()])
    table = stage.write(q.select(
        *[F.when(~F.col("_good"), F.col(c)).alias(c) if c in at else F.col(c) for c in df.columns],
        *[F.when(F.col("_good"), num(k)).alias(f"_num_{k}") for k in range(len(feature_cols))], "_good",
        F.when(~F.col("_good"), F.filter(named, lambda x: x.isNotNull())).alias("bad_features")), name)
    return (table.where("_good").select(*[F.col(f"_num_{at[c]}").alias(c) if c in at else F.col(c) for c in [*df.columns, *absent]]),
            table.where(~F.col("_good")).select(*df.columns, "bad_features"))


def rule_violations(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """``rules`` = (column, lo, hi, allowed codes); a NULL value is not checked.
    Adds ``violations``: the names of the rules a row breaks."""
    flags = []
    for col, lo, hi, allowed in rules:
        v = F.col(col)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (v < F.lit(lo))
        if hi is not None:
            bad = bad | (v > F.lit(hi))
        if allowed is not None:
            bad = bad | ~v.isin(*allowed)
        flags.append(F.when(v.isNotNull() & bad, F.lit(col)))
    return df.withColumn("violations", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def violation_counts(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """P26 report: per rule the number of checked rows and of violations, one pass; tall."""
    v = rule_violations(df, rules)
    aggs = [F.struct(F.lit(r[0]).alias("rule"), F.count(r[0]).alias("n_checked"),
                     F.count_if(F.array_contains("violations", r[0])).alias("n_violations"))
            for r in rules]
    aggs.append(F.struct(F.lit("*any*").alias("rule"), F.count(F.lit(1)).alias("n_checked"),
                         F.count_if(F.size("violations") > 0).alias("n_violations")))
    return v.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def decode(df: DataFrame, col: str, table: list[tuple], out: str, default=None,
           key_type: str = "int") -> DataFrame:
    """Code -> label through a lookup table with a default. The table is a fixed,
    small list of codes (its size is bounded by the code domain), so it is broadcast."""
    spark = df.sparkSession
    lut = spark.createDataFrame(table, f"_code {key_type}, _label string")
    joined = df.join(broadcast_if_small(lut, known_rows=len(table)), F.col(col) == F.col("_code"), "left")
    lab = F.coalesce(F.col("_label"), F.lit(default)) if default is not None else F.col("_label")
    return joined.withColumn(out, lab).drop("_code", "_label")


def decode_codes(df: DataFrame, table: list[tuple], suffix: str = "_label") -> DataFrame:
    """P27 over a whole form: ``table`` = (column, code, label); every named column gets a
    ``<column>_label`` (NULL for a code without one). The table is a map literal in the plan, so no
    join and no shuffle."""
    labels: dict[str, list] = {}
    for col, code, label in table:
        labels.setdefault(col, []).extend([F.lit(float(code)), F.lit(label)])
    return df.withColumns({f"{c}{suffix}": F.create_map(*kv)[F.col(c).cast("double")] for c, kv in labels.items() if c in df.columns})
