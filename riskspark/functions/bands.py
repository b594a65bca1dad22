"""Risk-band column expressions (P7-P9, P28, P29). All JVM-side CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BAND_GUIDANCE, BAND_LOW_MAX, BAND_MODERATE_MAX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_percent(prob) -> Column:
    """Probability fraction -> percent."""
    return _c(prob) * F.lit(100.0)


def risk_band(value, low_max: float = BAND_LOW_MAX, moderate_max: float = BAND_MODERATE_MAX) -> Column:
    """``< low_max`` Low, ``< moderate_max`` Moderate, else High.

    Thresholds are parameters so the same expression bands fractions (0.3/0.6) and
    percents (30/60). NULL and NaN fall through to High, like the lambda they replace.
    """
    v = _c(value)
    return (F.when(v < F.lit(low_max), F.lit("Low"))
            .when(v < F.lit(moderate_max), F.lit("Moderate"))
            .otherwise(F.lit("High")))


def risk_band_percent(pct) -> Column:
    return risk_band(pct, BAND_LOW_MAX * 100.0, BAND_MODERATE_MAX * 100.0)


def confidence(pct) -> Column:
    """max(pct, 100 - pct)."""
    p = _c(pct)
    return F.greatest(p, F.lit(100.0) - p)


def guidance(band) -> Column:
    """Guidance sentence per band."""
    b = _c(band)
    expr = None
    for name, text in BAND_GUIDANCE.items():
        expr = (F.when(b == F.lit(name), F.lit(text)) if expr is None
                else expr.when(b == F.lit(name), F.lit(text)))
    return expr


def band_sql(col: str, low_max: float = BAND_LOW_MAX, moderate_max: float = BAND_MODERATE_MAX) -> str:
    """The same band rule as SQL text (used by oracle queries)."""
    return (f"CASE WHEN {col} < CAST({low_max!r} AS DOUBLE) THEN 'Low' "
            f"WHEN {col} < CAST({moderate_max!r} AS DOUBLE) THEN 'Moderate' ELSE 'High' END")
