"""Column-expression helpers (all built-in Spark functions, no UDFs)."""

from .bands import band_sql, confidence, guidance, risk_band, risk_band_percent, risk_percent
from .coerce import binarize, missing_to_null, safe_double, strict_double
from .text import display_time, display_to_key, iso_text, key_to_display, parse_iso, pct_text
