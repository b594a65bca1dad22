"""Globally ordered operators without a single-partition shuffle.

A bare ``Window.orderBy`` plans ``Exchange SinglePartition``: the whole table goes through one task.
Instead:

1. ``repartitionByRange`` on the whole order key and a sort inside the partitions; every row gets its
   partition (``_bucket``) and its place in it, without another shuffle;
2. the rows with these two numbers are *written*. The range boundaries come from a sample, so a
   recomputed partition could differ; the written table pins them, and a lost executor rereads it;
3. one small table of the buckets' counts and sums, a row a bucket, becomes the buckets' exclusive
   offsets and is joined back (broadcast: as many rows as there are partitions).

The boundaries cover the *whole* composite key, which ends in a unique tie-breaker, so a hot value
of the first key (one timestamp holding a third of all rows, or NULL) is split over many buckets.
NULL keys come last, NaN after all numbers. The number of buckets is ``spark.sql.shuffle.partitions``
at every input size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import broadcast_if_small
from .staged import Staged

BUCKET = "_bucket"
LOCAL = "_lrn"
IDX = "_idx"
#: Rows of one block of the rolling mean: a task sorts and sums one block.
BLOCK_ROWS = 250_000


def ntz_micros(col: Column) -> Column:
    """Wall-clock microseconds since 1970-01-01 of a TIMESTAMP_NTZ, without any time zone."""
    return (F.unix_date(F.to_date(col)).cast("long") * F.lit(86_400_000_000)
            + F.hour(col).cast("long") * F.lit(3_600_000_000)
            + F.minute(col).cast("long") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), col) * F.lit(1_000_000)).cast("long"))


def null_safe(left: list[str], right: list[str]) -> Column:
    """Equality of two lists of columns in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def pinned_order(df: DataFrame, order_cols: list[str], n_buckets: int | None = None) -> DataFrame:
    """``df`` written in range order, with ``_bucket`` (contiguous ranges of the ascending composite
    key) and ``_lrn`` (1-based place inside the bucket)."""
    spark = df.sparkSession
    n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() for c in order_cols]
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn(BUCKET, F.shiftright("_m", 33).cast("int")) \
                   .withColumn(LOCAL, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1)).drop("_m")
    return Staged(spark, "order").write(placed, "rows")


def _offsets(rows: DataFrame, group_cols: list[str], sum_cols: list[str]) -> DataFrame:
    """Written table of one row per (group, bucket): rows and sums of the buckets before it."""
    before = Window.partitionBy(*[F.col(c) for c in group_cols]).orderBy(BUCKET) \
                   .rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group_cols, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_s_{s}") for s in sum_cols],
        *[F.count(s).alias(f"_c_{s}") for s in sum_cols])
    out = totals.select(*[F.col(c).alias(f"_k_{c}") for c in group_cols], F.col(BUCKET).alias("_ob"), "_n",
                        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"),
                        *[F.coalesce(F.sum(f"_{x}_{s}").over(before), F.lit(0)).alias(f"_o{x}_{s}")
                          for s in sum_cols for x in "sc"])
    return Staged(rows.sparkSession, "offsets").write(out, "offsets")


def _prefixed(rows: DataFrame, group_cols: list[str], sum_cols: list[str], known: int | None):
    """Rows of a pinned order with running numbers inside their group over all buckets."""
    offsets = _offsets(rows, group_cols, sum_cols)
    run = Window.partitionBy(BUCKET, *group_cols).orderBy(LOCAL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows
    if group_cols:
        local = local.withColumn("_place", F.count(F.lit(1)).over(run))
    for s in sum_cols:
        local = local.withColumn(f"_ls_{s}", F.coalesce(F.sum(s).over(run), F.lit(0))) \
                     .withColumn(f"_lc_{s}", F.count(s).over(run))
    on = (F.col(BUCKET) == F.col("_ob")) & null_safe(group_cols, [f"_k_{c}" for c in group_cols])
    out = local.join(broadcast_if_small(offsets, known_rows=known), on)
    place = F.col("_place") if group_cols else F.col(LOCAL)
    return out.withColumn(IDX, F.col("_on") + place), offsets


def global_prefix(df: DataFrame, order_cols: list[str], sum_cols: list[str] | None = None,
                  n_buckets: int | None = None) -> DataFrame:
    """Global 1-based row index ``_idx`` in ascending ``order_cols`` order (NULLs last) and,
    for each column ``s`` in ``sum_cols``, the inclusive running sum ``_cum_s`` and running
    non-NULL count ``_cnt_s``.

    ``order_cols`` should end in a unique column so the order is total; ties otherwise get
    an arbitrary order, the same for every reader of the result.
    """
    return _global(df, order_cols, list(sum_cols or []), n_buckets)[0]


def _global(df: DataFrame, order_cols: list[str], sum_cols: list[str], n_buckets: int | None):
    rows = pinned_order(df, order_cols, n_buckets)
    n = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, offsets = _prefixed(rows, [], sum_cols, known=n)
    return out.select(*df.columns, IDX, *[(F.col(f"_os_{s}") + F.col(f"_ls_{s}")).alias(f"_cum_{s}") for s in sum_cols],
                      *[(F.col(f"_oc_{s}") + F.col(f"_lc_{s}")).alias(f"_cnt_{s}") for s in sum_cols]), offsets


def global_row_index(df: DataFrame, order_cols: list[str], n_buckets: int | None = None,
                     name: str = "row_index") -> DataFrame:
    """1-based position after a global sort on ``order_cols`` (no single partition; the
    rows are shuffled once)."""
    return global_prefix(df, order_cols, n_buckets=n_buckets).withColumnRenamed(IDX, name)


def grouped_prefix(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   sum_cols: list[str], n_buckets: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` within each group (NULL is a group), ordered by ``order_cols``.

    Rows are in range order of (groups..., order...), so a group spans neighbouring buckets and a
    hot group many of them; a bucket's offset is per group. Adds ``_gidx`` (1-based index in the
    group) and ``_gcum_s``.
    """
    group_cols = list(group_cols)
    rows = pinned_order(df, group_cols + list(order_cols), n_buckets)
    out, _ = _prefixed(rows, group_cols, sum_cols, known=None)
    return out.select(*df.columns, F.col(IDX).alias("_gidx"),
                      *[(F.col(f"_os_{s}") + F.col(f"_ls_{s}")).alias(f"_gcum_{s}") for s in sum_cols])


def sliding_sums(rows: DataFrame, pos: str, cols: list[str], width: int, total: int,
                 block: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (dense positions 0 .. total-1 in ``pos``, no NULL in ``cols``) with ``_w_<c>``: the sum
    of ``c`` over positions pos-width+1 .. pos (fewer at the start).

    Positions are cut into blocks of at most ``block`` rows. A frame is the end of the block it
    begins in, whole blocks, and the beginning of its last block: sums inside one block from either
    side, and sliding sums over the much smaller table of block sums (this function again). Only
    values inside the frame are ever added, nothing is subtracted, so a huge or infinite value
    outside a frame leaves no trace in it. Each row is sent under its own position and, with the sum
    from it to its block's end, to the position whose frame it begins: at most two rows a key.
    """
    s = min(width, block)
    q, r = divmod(width - 1, s)
    p = F.col(pos)
    own = F.expr(f"`{pos}` div {s}")
    up = Window.partitionBy("_b").orderBy(p.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("_b").orderBy(p.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.withColumn("_b", own)
    x = x.withColumns({f"_p_{c}": F.sum(c).over(up) for c in cols}).withColumns({f"_q_{c}": F.sum(c).over(down) for c in cols})
    payload = F.struct(*rows.columns)
    kind = rows.select(payload.alias("r")).schema["r"].dataType
    ahead = p + F.lit(width - 1)
    other_block = F.expr(f"(`{pos}` + {width - 1}) div {s}") != F.col("_b")
    here = F.struct(p.alias("_key"), payload.alias("_row"), *[F.col(f"_p_{c}").alias(f"_p_{c}") for c in cols],
                    *[F.lit(None).cast(x.schema[f"_q_{c}"].dataType).alias(f"_q_{c}") for c in cols])
    there = F.struct(ahead.alias("_key"), F.lit(None).cast(kind).alias("_row"),
                     *[F.lit(None).cast(x.schema[f"_p_{c}"].dataType).alias(f"_p_{c}") for c in cols],
                     *[F.when(other_block, F.col(f"_q_{c}")).alias(f"_q_{c}") for c in cols])
    sent = F.when(ahead < F.lit(total), F.array(here, there)).otherwise(F.array(here))
    pairs = x.select(F.explode(sent).alias("e")).select("e.*").groupBy("_key").agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        *[F.sum(f"_{k}_{c}").alias(f"_{k}_{c}") for c in cols for k in "pq"])
    sums = {c: F.coalesce(F.col(f"_q_{c}"), F.lit(0)) + F.col(f"_p_{c}") for c in cols}
    if q:
        n_blocks = -(-total // s)
        pairs = pairs.join(broadcast_if_small(_between(rows, own, cols, q, n_blocks, block), known_rows=n_blocks),
                           F.expr(f"_key div {s}") == F.col("_mb"), "left")
        whole = F.pmod(F.col("_key"), F.lit(s)) >= F.lit(r)  # the frame begins a block later
        sums = {c: F.coalesce(F.col(f"_q_{c}"), F.lit(0))
                + F.coalesce(F.when(whole, F.col(f"_less_{c}")).otherwise(F.col(f"_more_{c}")), F.lit(0))
                + F.col(f"_p_{c}") for c in cols}
    return pairs.select("_row.*", *[v.alias(f"_w_{c}") for c, v in sums.items()])


def _between(rows: DataFrame, own: Column, cols: list[str], q: int, n_blocks: int, block: int) -> DataFrame:
    """Per block ``_mb``: sums of the q blocks before it (``_more_``) and of the q-1 (``_less_``)."""
    blocks = Staged(rows.sparkSession, "blocks").write(
        rows.groupBy(own.alias("_bp")).agg(*[F.sum(c).alias(c) for c in cols]), "blocks")
    nxt = (F.col("_bp") + F.lit(1)).alias("_mb")
    more = sliding_sums(blocks, "_bp", cols, q, n_blocks, block).select(
        nxt, *[F.col(f"_w_{c}").alias(f"_more_{c}") for c in cols])
    if q == 1:
        return more.withColumns({f"_less_{c}": F.lit(None).cast(blocks.schema[c].dataType) for c in cols})
    less = sliding_sums(blocks, "_bp", cols, q - 1, n_blocks, block).select(
        nxt, *[F.col(f"_w_{c}").alias(f"_less_{c}") for c in cols])
    return more.join(less, "_mb")


def rolling_mean(df: DataFrame, value_col: str, order_cols: list[str], window: int | None = None,
                 divisor: int = 5, n_buckets: int | None = None, name: str = "rolling_mean",
                 block: int = BLOCK_ROWS) -> DataFrame:
    """Trailing mean over the last ``window`` rows in global order, ``min_periods=1``.

    ``window`` defaults to ``max(1, total // divisor)``. NULL and NaN values are skipped (the mean of
    the values in the frame; NULL when it has none), as a pandas rolling mean. Sums and counts of
    the frames come from :func:`sliding_sums`; sums of whole numbers are exact.
    """
    idx, offsets = _global(df, order_cols, [], n_buckets)
    total = offsets.agg(F.sum("_n")).first()[0] or 0
    w = window if window is not None else max(1, total // divisor)
    whole = isinstance(df.schema[value_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    v = F.col(value_col) if whole else F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    rows = idx.withColumn("_pos", F.col(IDX) - F.lit(1)) \
              .withColumn("_v", F.coalesce(v, F.lit(0)).cast("long" if whole else "double")) \
              .withColumn("_c", v.isNotNull().cast("long"))
    out = sliding_sums(rows, "_pos", ["_v", "_c"], w, total, block)
    mean = F.try_divide(F.col("_w__v").cast("double"), F.col("_w__c").cast("double"))
    return out.select(F.col(IDX).alias("row_index"), *df.columns, mean.alias(name), F.lit(w).alias("window_rows"))
