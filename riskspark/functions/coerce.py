"""Numeric coercion expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MISSING_MARKER


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing_to_null(text, marker: str = MISSING_MARKER) -> Column:
    """The missing marker becomes NULL."""
    return F.nullif(_c(text), F.lit(marker))


def strict_double(text) -> Column:
    """Cast to double; under ANSI mode junk raises (like ``pd.to_numeric``)."""
    return _c(text).cast("double")


def safe_double(text) -> Column:
    """Junk -> NULL (``errors="coerce"``)."""
    return _c(text).try_cast("double")


def binarize(target, threshold: float = 0.0) -> Column:
    """1 when ``target > threshold`` else 0 (NULL stays 0, as the lambda does)."""
    return F.when(_c(target) > F.lit(threshold), F.lit(1)).otherwise(F.lit(0))
