"""Text / time formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_text(ts) -> Column:
    """Timestamp -> ISO-8601 text as Python's ``isoformat`` writes it.

    The fraction is printed with 6 digits and left out entirely when it is zero.
    """
    t = _c(ts).cast("string")  # TIMESTAMP_NTZ prints its own fields, whatever the session zone
    whole, micros = F.concat(t.substr(1, 10), F.lit("T"), t.substr(12, 8)), t.substr(21, 6)
    return F.when(micros == F.lit(""), whole).otherwise(F.concat(whole, F.lit("."), F.rpad(micros, 6, "0")))


def parse_iso(text) -> Column:
    """ISO text (with or without a fraction) -> TIMESTAMP_NTZ."""
    return F.to_timestamp_ntz(_c(text))


def display_time(ts) -> Column:
    """``%b %d %Y, %H:%M``."""
    t = _c(ts).cast("string")
    month = F.date_format(F.to_date(t.substr(1, 10)), "MMM")
    return F.concat(month, F.lit(" "), t.substr(9, 2), F.lit(" "), t.substr(1, 4), F.lit(", "), t.substr(12, 5))


def pct_text(frac, decimals: int = 1) -> Column:
    """Fraction -> percent text such as ``42.5%`` (presentation only, T7)."""
    return F.format_string(f"%.{decimals}f%%", _c(frac) * F.lit(100.0))


def key_to_display(key) -> Column:
    """``random_forest`` -> ``Random Forest``."""
    return F.initcap(F.regexp_replace(_c(key), "_", " "))


def display_to_key(name) -> Column:
    """P22 inverse: ``Random Forest`` -> ``random_forest``."""
    return F.lower(F.regexp_replace(_c(name), " ", "_"))
