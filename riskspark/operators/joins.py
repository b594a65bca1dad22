"""Size-checked broadcast: broadcast a side only when its row count is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side (rows) that is broadcast; beyond it the join stays a shuffle join.
BROADCAST_MAX_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows, else ``df`` unchanged (AQE
    may still pick a broadcast at run time from measured sizes). ``known_rows`` skips the
    count when the size is fixed by construction (a code table, the bands)."""
    n = known_rows if known_rows is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
