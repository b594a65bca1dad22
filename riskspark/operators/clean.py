"""Cleaning: missing markers, numeric coercion, NULL profile, median imputation
(P1-P3, P20, P21, A9, A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import missing_to_null, safe_double, strict_double
from .quantiles import exact_quantiles


def coerce_numeric(df: DataFrame, cols: list[str], strict: bool = True) -> DataFrame:
    """P1 + P2/P3: ``?`` -> NULL, then cast to double (strict raises on junk under ANSI,
    safe turns junk into NULL)."""
    conv = strict_double if strict else safe_double
    return df.withColumns({c: conv(missing_to_null(F.col(c).cast("string"))) for c in cols})


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A9 + P21: NULL count per column and whether it has any value, in one pass; tall."""
    aggs = []
    for c in cols:
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"),
                             (F.count(c) > 0).alias("has_values")))
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("e")).select("e.*")


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact (interpolating) median of each column: the columns are stacked into one tall
    (column, value) frame and handled by one distributed quantile job."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                               for c in cols])).alias("e")
    tall = df.select(stack).select("e.column", "e.value")
    med = exact_quantiles(tall, "value", [0.5], ["median"], group_cols=["column"]).collect()
    got = {r["column"]: r["median"] for r in med}  # one row per column
    return {c: got.get(c) for c in cols}


def median_impute(df: DataFrame, cols: list[str], medians: dict[str, float | None] | None = None) -> DataFrame:
    """A10: NULL -> the column's exact median (pandas ``fillna(median())``); the medians are
    fitted parameters and can be passed in (fit on train, apply on test)."""
    medians = medians if medians is not None else column_medians(df, cols)
    fills = {c: v for c, v in medians.items() if v is not None}
    return df.na.fill(fills) if fills else df


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """P20: drop rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=cols)
