"""Exact, interpolating quantiles by radix selection.

Spark's ``percentile`` keeps a value -> count map per group in one aggregation buffer, and a sort
moves every row. Here only counts move:

1. every value falls into a bin of its sign and magnitude (4,096 bins a power of two; monotone, so
   bins are in value order). One histogram per group, pre-aggregated in the map tasks, says which
   bin holds each wanted rank, and the bin's smallest and largest value;
2. bins that hold more than one value are cut into 2**20 equal parts, again by a histogram of the
   rows in them only;
3. of what is left (at most some two million neighbouring doubles a bin) the values themselves are
   counted.

Three passes at most; a pass is left out when every rank is found. The ranks ``floor(q (n-1))`` and
``ceil(q (n-1))`` are then interpolated linearly, as pandas ``quantile`` and SQL ``quantile_cont``.

NULL and NaN values are skipped (pandas semantics). A NULL group is a group; groups without values
produce no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small
from .ordered import null_safe
from .staged import Staged

#: Bins of the first pass in each power of two, and parts of a bin in the second.
COARSE = 4096
PARTS = 1 << 20


def _coarse(v: Column) -> Column:
    """Bin of a double: 0 for zero, else the sign times a number that grows with the logarithm."""
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1025.0)) + F.lit(1075.0)) * F.lit(float(COARSE))) + F.lit(1)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _found(hist: DataFrame, keys: list[str], order: str, wanted: Column) -> DataFrame:
    """Histogram rows (n rows of ``keys``, in the order of ``order``) that hold wanted ranks, with
    ``hits``: (k, total, rank inside the row). ``wanted`` is an array of (k, total, rank inside ``keys``)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("_cum") - F.col("n")
    mine = F.filter("_wanted", lambda t: (t["rank"] >= first) & (t["rank"] < F.col("_cum")))
    return (hist.withColumn("_cum", F.sum("n").over(w)).withColumn("_wanted", wanted)
            .withColumn("hits", F.transform(mine, lambda t: F.struct(t["k"].alias("k"), t["total"].alias("total"),
                                                                   (t["rank"] - first).alias("rank"))))
            .where(F.size("hits") > 0).drop("_cum", "_wanted"))


def _narrow(rows: DataFrame, open_: DataFrame, keys: list[str], part: Column, name: str) -> DataFrame:
    """Next pass: rows of the ``open_`` bins by ``part``, with the bins' ranks handed down."""
    lows = [F.col(c).alias(f"_o_{c}") for c in keys]
    side = broadcast_if_small(open_.select(*lows, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))
    inside = rows.join(side, null_safe(keys, [f"_o_{c}" for c in keys]))
    hist = inside.select(*keys, "v", part.alias(name)).groupBy(*keys, name).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = broadcast_if_small(open_.select(*lows, F.col("hits").alias("_hits")))
    hist = hist.join(ranks, null_safe(keys, [f"_o_{c}" for c in keys])).drop(*[f"_o_{c}" for c in keys])
    return _found(hist, keys, name, F.col("_hits")).drop("_hits")


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], names: list[str] | None = None,
                    group_cols: list[str] | None = None, moments: bool = False,
                    coarse: int = COARSE, parts: int = PARTS) -> DataFrame:
    """One row per group with a column per probability (``names`` or ``q<p>``) and ``n``;
    with ``moments`` also min, max, mean and sample sd (NULL for one value); NULL groups
    are kept. ``coarse`` and ``parts`` size the histograms, not the result."""
    group_cols = list(group_cols or [])
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    g = [f"_g{i}" for i in range(len(group_cols))]
    stage = Staged(df.sparkSession, "quantiles")
    v = F.col(value_col).cast("double")
    rows = df.select(*[F.col(c).alias(x) for c, x in zip(group_cols, g)], v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    scale = F.lit(float(coarse) / COARSE)
    binned = rows.withColumn("bin", F.floor(_coarse(F.col("v")) * scale) if coarse != COARSE else _coarse(F.col("v")))

    hist = binned.groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    hist = hist.withColumn("total", F.sum("n").over(Window.partitionBy(*g)))
    h = [F.lit(float(p)) * (F.col("total") - F.lit(1)).cast("double") for p in probs]
    ranks = [f(x).cast("long") for x in h for f in (F.floor, F.ceil)]
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.col("total").alias("total"), r.alias("rank")) for k, r in enumerate(ranks)])
    picks = stage.write(_found(hist, g, "bin", wanted), "pass-1")

    done = [picks.where(F.col("lo") == F.col("hi")).select(*g, "hits", F.col("lo").alias("value"))]
    open_ = picks.where(F.col("lo") < F.col("hi"))
    if open_.limit(1).count():
        keys = [*g, "bin"]
        part = F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(parts)))
        second = stage.write(_narrow(binned, open_, keys, part, "part"), "pass-2")
        done.append(second.where(F.col("lo") == F.col("hi")).select(*g, "hits", F.col("lo").alias("value")))
        left = second.where(F.col("lo") < F.col("hi"))
        if left.limit(1).count():
            # The part of a row is asked with its bin's bounds again.
            edge = broadcast_if_small(open_.select(*[F.col(c).alias(f"_b_{c}") for c in keys], F.col("lo").alias("_lo"),
                                                   F.col("hi").alias("_hi")))
            cut = binned.join(edge, null_safe(keys, [f"_b_{c}" for c in keys])).withColumn("part", part) \
                        .drop("_lo", "_hi", *[f"_b_{c}" for c in keys])
            third = stage.write(_narrow(cut, left, [*keys, "part"], F.col("v"), "value"), "pass-3")
            done.append(third.select(*g, "hits", "value"))

    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    found = [f"_v{k}" for k in range(2 * len(probs))]
    every = every.select(*g, F.explode("hits").alias("t"), "value").select(
        *g, F.col("t.total").alias("n"), *[F.when(F.col("t.k") == k, F.col("value")).alias(c) for k, c in enumerate(found)])
    if moments:  # from the rows themselves: sums of squares cancel when the values share a large offset
        every = every.unionByName(rows.groupBy(*g).agg(
            F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")),
            allowMissingColumns=True)
    out = every.groupBy(*g).agg(*[F.max(c).alias(c) for c in every.columns if c not in g]).where(F.col("n").isNotNull())
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - F.lit(1)).cast("double")
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        out = out.withColumn(f"_q{i}", F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))))
    return out.select(*[F.col(x).alias(c) for c, x in zip(group_cols, g)], "n",
                      *[F.col(f"_q{i}").alias(nm) for i, nm in enumerate(names)],
                      *(["min", "max", "mean", "sd"] if moments else []))


def approx_quantiles(df: DataFrame, value_col: str, probs: list[float], names: list[str] | None = None,
                     group_cols: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """A7, large-scale option: ``percentile_approx`` (a mergeable sketch of bounded size per
    group, relative rank error about 1 / accuracy). Values are sample points, not
    interpolated, so they differ from the exact linear quantiles by at most that rank error."""
    group_cols = list(group_cols or [])
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    v = F.col(value_col)
    est = F.percentile_approx(v, [float(p) for p in probs], accuracy)
    out = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), est.alias("_q"))
    return out.select(*group_cols, "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
