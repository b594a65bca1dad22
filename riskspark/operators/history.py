"""Score-history normalisation and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_iso
from ..schemas import FEATURE_KEYS, UNKNOWN_MODEL


def flatten_nested(df: DataFrame, nested_col: str = "input_data", keys: list[str] | None = None,
                   model_col: str = "model_used", default_model: str = UNKNOWN_MODEL) -> DataFrame:
    """Lift every field of the nested struct to the top level (a nested value
    wins, an explicit null too, as long as the struct itself is there), make sure every feature column exists (NULL when absent), default the
    model key, and drop the store key ``_id`` and the struct itself."""
    keys = list(keys if keys is not None else FEATURE_KEYS)
    out = df
    nested = nested_col in df.columns and isinstance(df.schema[nested_col].dataType, T.StructType)
    nested_fields = set(df.schema[nested_col].dataType.fieldNames()) if nested else set()
    for k in sorted(set(keys) | nested_fields):
        top = F.col(k) if k in df.columns else F.lit(None).cast("double")
        if k in nested_fields:
            inner = F.col(f"{nested_col}.{k}")
            out = out.withColumn(k, F.when(F.col(nested_col).isNotNull(), inner).otherwise(top))
        elif k not in df.columns:
            out = out.withColumn(k, top)
    if model_col in out.columns:
        out = out.withColumn(model_col, F.coalesce(F.col(model_col), F.lit(default_model)))
    else:
        out = out.withColumn(model_col, F.lit(default_model))
    return out.drop(nested_col, "_id")


def normalise_json(df: DataFrame, text_col: str = "json", keys: list[str] | None = None, strict: bool = True,
                   nested: str = "input_data", model_col: str = "model_used", default_model: str = UNKNOWN_MODEL,
                   carry: list[str] | None = None) -> DataFrame:
    """P10-P13 on record texts, read as VARIANT, where an absent key and an explicit null differ.

    Columns: ``carry``, every feature of ``keys`` (a key inside ``nested`` wins, an explicit null
    too; else the top-level one; NULL when neither is there or it is no number), and ``model_col``.
    ``strict`` fills the model only where the key is absent, as ``setdefault`` does (T6); otherwise
    an explicit null is filled too. A text that is no JSON object has neither."""
    keys = list(keys if keys is not None else FEATURE_KEYS)
    v = df.withColumn("_v", F.try_parse_json(F.col(text_col)))

    def get(path: str, kind: str):
        return F.try_variant_get("_v", path, kind)

    cols = {}
    for k in keys:
        inside = get(f"$.{nested}.{k}", "variant").isNotNull()  # an explicit null is a variant value
        cols[k] = F.when(inside, get(f"$.{nested}.{k}", "double")).otherwise(get(f"$.{k}", "double"))
    named = get(f"$.{model_col}", "string")
    absent = get(f"$.{model_col}", "variant").isNull() if strict else named.isNull()
    model = F.when(absent, F.lit(default_model)).otherwise(named)
    return v.select(*(carry or []), *[c.alias(k) for k, c in cols.items()], model.alias(model_col))


def union_history(primary: DataFrame, fallback: DataFrame, default_model: str = UNKNOWN_MODEL,
                  keys: list[str] | None = None, ts_col: str = "timestamp") -> DataFrame:
    """O1: both stores, each normalised, stacked by column name (columns missing on one side
    become NULL) with a ``source`` column; no shuffle, just a union of scans. Every feature key is a
    column (P11); a time kept as ISO text is parsed (P15), so both sides hold the same type."""
    def side(df: DataFrame, name: str) -> DataFrame:
        out = flatten_nested(df, default_model=default_model, keys=list(keys if keys is not None else FEATURE_KEYS))
        if ts_col in out.columns and isinstance(out.schema[ts_col].dataType, T.StringType):
            out = out.withColumn(ts_col, parse_iso(ts_col))
        return out.withColumn("source", F.lit(name))

    return side(primary, "primary").unionByName(side(fallback, "fallback"), allowMissingColumns=True)
