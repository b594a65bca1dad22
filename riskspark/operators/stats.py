"""Descriptive statistics over the score history (A1-A15, A17) and correlation.

All single-pass aggregations with partial (map-side) aggregation; per-band work is one
``groupBy`` instead of a loop over categories. Band-level parameter tables (three rows,
one per band) are the only broadcasts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import risk_band, risk_band_percent, risk_percent
from ..schemas import HIGH_KPI_PERCENT, HIST_BINS, HIST_HI, HIST_LO
from .joins import broadcast_if_small
from .quantiles import exact_quantiles
from .staged import Staged


def scored(h: DataFrame) -> DataFrame:
    """P7 + P8: add ``risk_percent`` and ``risk_band`` to a history frame."""
    return h.withColumn("risk_percent", risk_percent("probability")) \
            .withColumn("risk_band", risk_band("probability"))


def risk_kpis(h: DataFrame) -> DataFrame:
    """Totals, per-band counts and shares, mean score, strict ``> 60`` count."""
    p = F.col("probability")
    band = risk_band(p)
    total = F.count(F.lit(1))
    cnt = {b: F.count_if(band == F.lit(b)) for b in ("Low", "Moderate", "High")}
    out = h.agg(
        total.alias("total"),
        cnt["Low"].alias("low_n"), cnt["Moderate"].alias("moderate_n"), cnt["High"].alias("high_n"),
        F.count_if(risk_percent(p) > F.lit(HIGH_KPI_PERCENT)).alias("over_60_n"),
        F.avg(p).alias("avg_probability"),
        F.avg(risk_percent(p)).alias("avg_risk_percent"),
    )
    for b in ("low", "moderate", "high", "over_60"):
        out = out.withColumn(f"{b}_share", F.try_divide(F.col(f"{b}_n") * F.lit(100.0), F.col("total")))
    out = out.withColumn("avg_band", F.when(F.col("total") > 0, risk_band("avg_probability")))
    return out


def risk_distribution(h: DataFrame) -> DataFrame:
    """Count per band, largest first, with share of total."""
    counts = scored(h).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the three band rows only
    return (counts.withColumn("share", F.col("n") * F.lit(100.0) / total)
            .orderBy(F.desc("n"), F.asc("risk_band")))


def score_summary(df: DataFrame, value_col: str = "risk_percent") -> DataFrame:
    """Min, quartiles, max, mean and sample sd (NULL for one row) of one column."""
    q = exact_quantiles(df, value_col, [0.25, 0.5, 0.75], ["q25", "median", "q75"], moments=True)
    return q.select("n", "min", "q25", "median", "q75", "max", "mean", "sd")


def hist_edges(bins: int = HIST_BINS, lo: float = HIST_LO, hi: float = HIST_HI) -> list[float]:
    """Bin edges exactly as ``linspace(lo, hi, bins + 1)``."""
    return [float(x) for x in np.linspace(lo, hi, bins + 1)]


def histogram(df: DataFrame, value_col: str = "risk_percent", bins: int = HIST_BINS,
              lo: float = HIST_LO, hi: float = HIST_HI) -> DataFrame:
    """Equal-width bins on [lo, hi], last bin closed, values outside dropped; every bin
    is reported (empty ones with 0), with its centre and the band of the centre (P9)."""
    edges = hist_edges(bins, lo, hi)
    v = F.col(value_col)
    idx = F.when(v < F.lit(edges[1]), F.lit(1))
    for i in range(2, bins):
        idx = idx.when(v < F.lit(edges[i]), F.lit(i))
    idx = idx.otherwise(F.lit(bins))
    counts = (df.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
              .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    spark = df.sparkSession
    lo_arr = F.array(*[F.lit(e) for e in edges[:-1]])
    hi_arr = F.array(*[F.lit(e) for e in edges[1:]])
    frame = (spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
             .withColumn("bin_lo", F.element_at(lo_arr, F.col("bin")))
             .withColumn("bin_hi", F.element_at(hi_arr, F.col("bin"))))
    out = frame.join(broadcast_if_small(counts, known_rows=bins), "bin", "left")  # <= bins rows
    out = out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    out = out.withColumn("center", (F.col("bin_lo") + F.col("bin_hi")) / F.lit(2.0))
    return out.withColumn("band", risk_band_percent("center")).orderBy("bin")


def _fences(df: DataFrame, value_col: str, group_col: str, whisker: float) -> DataFrame:
    """Per group (``_group``; NULL is one): n, quartiles, IQR and the fences."""
    q = exact_quantiles(df, value_col, [0.25, 0.5, 0.75], ["q1", "median", "q3"], group_cols=[group_col])
    return (q.withColumnRenamed(group_col, "_group").withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower_fence", F.col("q1") - F.lit(whisker) * F.col("iqr"))
            .withColumn("upper_fence", F.col("q3") + F.lit(whisker) * F.col("iqr")))


def box_stats(df: DataFrame, value_col: str = "risk_percent", group_col: str = "risk_band",
              whisker: float = 1.5, max_groups: int | None = None) -> DataFrame:
    """Per group (NULL is one) quartiles (linear), IQR fences, whisker ends (extreme points
    inside the fences), mean, sample sd, min, max and outlier count. ``max_groups`` is a bound on
    the number of groups known by construction (three bands); without it the size of the
    per-group table is checked before it is broadcast."""
    fences = broadcast_if_small(_fences(df, value_col, group_col, whisker), known_rows=max_groups)
    v = F.col(value_col)
    joined = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(group_col), F.col(value_col)) \
               .join(fences, F.col(group_col).eqNullSafe(F.col("_group")))
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    mine = ["n", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]  # one value a group
    return joined.groupBy(group_col).agg(
        *[F.first(c).alias(c) for c in mine],
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).select(
        group_col, "n", "min", "q1", "median", "q3", "max", "iqr", "lower_fence", "upper_fence",
        "whisker_lo", "whisker_hi", "n_outliers", "mean", "sd")


def outliers(df: DataFrame, id_col: str = "record_id", value_col: str = "risk_percent",
             group_col: str = "risk_band", whisker: float = 1.5, max_groups: int | None = None) -> DataFrame:
    """A15 points: rows outside their group's fences (NULL is a group)."""
    fences = _fences(df, value_col, group_col, whisker).select("_group", "lower_fence", "upper_fence")
    v = F.col(value_col)
    return (df.select(id_col, group_col, value_col)
            .join(broadcast_if_small(fences, known_rows=max_groups), F.col(group_col).eqNullSafe(F.col("_group")))
            .where(((v < F.col("lower_fence")) | (v > F.col("upper_fence"))) & ~F.isnan(v))
            .select(id_col, group_col, value_col, "lower_fence", "upper_fence"))


def kde_params(df: DataFrame, value_col: str, group_col: str, max_groups: int | None = None) -> DataFrame:
    """Per group: n, min, max and Silverman's bandwidth 0.9 * min(sd, iqr / 1.349) * n^-0.2
    (sd alone when the IQR is 0)."""
    bs = box_stats(df, value_col, group_col, max_groups=max_groups)
    spread = F.when(F.col("iqr") > 0, F.least(F.col("sd"), F.col("iqr") / F.lit(1.349))).otherwise(F.col("sd"))
    return bs.select(group_col, "n", "min", "max",
                     (F.lit(0.9) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


#: Density bins in a bandwidth, power sums kept of each, and the kernel's reach in bandwidths.
KDE_BINS = 32
KDE_POWERS = 6
KDE_REACH = 9.0


def density(df: DataFrame, value_col: str = "chol", group_col: str = "risk_band",
            points: int = 50, max_groups: int | None = None) -> DataFrame:
    """A15 violin body: Gaussian kernel density on ``points`` equally spaced values between
    the group's min and max (NULL is a group; one without spread has no density).

    Rows are counted into bins of 1/32 bandwidth, with the power sums of their distances to the
    bin's centre: one map-side combined aggregate, no row meets the grid. The bins are then
    convolved with the kernel. Around a centre c at distance u bandwidths from the grid point, a
    value c + t bw adds exp(-u^2/2) sum_m He_m(u) t^m / m!, so a bin needs its power sums only;
    |t| is at most 1/64, so six powers leave a relative error near 1e-12. A bin asks the grid
    points within nine bandwidths (beyond, the kernel is below 1e-17 of its height)."""
    params = kde_params(df, value_col, group_col, max_groups).where(F.col("bw") > 0).withColumnRenamed(group_col, "_group")
    params = Staged(df.sparkSession, "density").write(params, "params")  # read for rows and bins
    side = broadcast_if_small(params, known_rows=max_groups)
    v = F.col(value_col)
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(group_col, v.cast("double").alias("_v")) \
             .join(side, F.col(group_col).eqNullSafe(F.col("_group")))
    steps = (F.col("_v") - F.col("min")) / F.col("bw") * F.lit(float(KDE_BINS))
    t = (steps - F.floor(steps) - F.lit(0.5)) / F.lit(float(KDE_BINS))
    binned = rows.select("_group", F.floor(steps).alias("bin"), t.alias("t"))
    power, sums = F.lit(1.0), []
    for m in range(KDE_POWERS):
        sums.append(F.sum(power / F.lit(float(math.factorial(m)))).alias(f"s{m}"))
        power = power * F.col("t")
    bins = binned.groupBy("_group", "bin").agg(*sums).withColumnRenamed("_group", "_g")
    step = (F.col("max") - F.col("min")) / F.lit(float(points - 1))
    center = (F.col("bin") + F.lit(0.5)) / F.lit(float(KDE_BINS)) * F.col("bw")  # above min
    reach = F.lit(KDE_REACH) * F.col("bw")
    first = F.greatest(F.ceil((center - reach) / step), F.lit(0))
    last = F.least(F.floor((center + reach) / step), F.lit(points - 1))
    # A grid point beyond every bin's reach has density 0 and still a row.
    near = bins.join(side, F.col("_g").eqNullSafe(F.col("_group"))).where(first <= last).select(
        "_group", "bw", "bin", step.alias("step"), *[f"s{m}" for m in range(KDE_POWERS)], F.explode(F.sequence(first, last)).alias("k"))
    u = F.col("k") * F.col("step") / F.col("bw") - (F.col("bin") + F.lit(0.5)) / F.lit(float(KDE_BINS))
    near = near.withColumn("u", u)
    h = [F.lit(1.0), F.col("u")]
    for m in range(2, KDE_POWERS):
        h.append(F.col("u") * h[m - 1] - F.lit(float(m - 1)) * h[m - 2])
    kern = F.exp(F.lit(-0.5) * F.col("u") * F.col("u")) * sum((h[m] * F.col(f"s{m}") for m in range(1, KDE_POWERS)), F.col("s0"))
    sums = near.select("_group", F.col("k").cast("int").alias("k"), kern.alias("kern"))
    grid = params.select("_group", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), F.lit(0.0).alias("kern"))
    total = sums.unionByName(grid).groupBy("_group", "k").agg(F.sum("kern").alias("kern")).withColumnRenamed("_group", "_g")
    return total.join(side, F.col("_g").eqNullSafe(F.col("_group"))).select(
        F.col("_g").alias(group_col), "k", (F.col("min") + F.col("k") * (F.col("max") - F.col("min")) / F.lit(float(points - 1))).alias("x"),
        (F.col("kern") / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def trend_fit(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """Least-squares line y = slope * x + intercept (needs >= 2 rows; NULL and NaN dropped)."""
    x, y = F.col(x_col).cast("double"), F.col(y_col).cast("double")
    d = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    fit = d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y_col, x_col).alias("slope"),
                F.regr_intercept(y_col, x_col).alias("intercept"),
                F.min(x_col).cast("double").alias("x_min"), F.max(x_col).cast("double").alias("x_max"))
    return fit.where(F.col("n") >= 2)


def trend_line(df: DataFrame, x_col: str, y_col: str, points: int = 100) -> DataFrame:
    """A13 line: ``points`` x values as ``linspace(min, max)`` and the fitted y."""
    fit = trend_fit(df, x_col, y_col)
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))
    x = F.when(F.col("k") == F.lit(points - 1), F.col("x_max")).otherwise(F.col("x_min") + F.col("k") * step)
    return (fit.select("slope", "intercept", "x_min", "x_max", k).withColumn("x", x)
            .withColumn("y", F.col("slope") * F.col("x") + F.col("intercept"))
            .select("k", "x", "y"))


def latest_score(h: DataFrame) -> DataFrame:
    """The most recent record (ties on time broken by record_id) - an aggregate, no sort."""
    s = scored(h)
    key = F.struct("timestamp", "record_id")
    best = s.agg(F.max_by(F.struct("record_id", "timestamp", "risk_percent", "risk_band"), key).alias("r"))
    return best.select("r.record_id", "r.timestamp", "r.risk_percent", "r.risk_band")


#: Rows whose mean shifts the columns before their products are summed.
SHIFT_ROWS = 1000


def _gram(shift: list[float]):
    """Arrow batches to one row per column pair (i <= j) and task: the pair's sums over the rows that
    hold both. One matrix product of values, presence masks and squares a batch; the task's state is
    that matrix, whatever the number of rows."""
    d, c = len(shift), np.array(shift)

    def run(batches):
        state = np.zeros((3 * d, 3 * d))
        for b in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False).astype(float) for col in b.columns]) - c
            held = ~np.isnan(x)  # NULL and NaN are missing
            x = np.where(held, x, 0.0)
            z = np.hstack([x, held, x * x])
            state += z.T @ z
        i, j = np.triu_indices(d)
        cells = {"i": i, "j": j, "n": state[d + i, d + j], "sx": state[i, d + j], "sy": state[j, d + i],
                 "sxy": state[i, j], "sxx": state[2 * d + i, d + j], "syy": state[2 * d + j, d + i]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(np.int32 if k in "ij" else float)) for k, v in cells.items()], list(cells))
    return run


def corr_matrix(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson correlation on pairwise-complete rows (NULL and NaN are missing), tall
    ``(x, y, r)`` for every ordered pair (or just ``pairs``); a constant column gives NULL instead of
    a division error.

    One pass: every task folds its rows into one Gram matrix of values and masks, and the tasks'
    matrices are summed. The columns are shifted by the mean of the first rows, so that sums of
    squares do not cancel when the values share a large offset. A variance below 1e-12 of the
    pair's second moment counts as constant."""
    want = pairs or [(a, b) for a in cols for b in cols]
    used = sorted({c for p in want for c in p})
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in used])
    near = rows.limit(SHIFT_ROWS).agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in used]).first()
    shift = [m if m is not None and math.isfinite(m) else 0.0 for m in (near[c] for c in used)]
    sums = rows.mapInArrow(_gram(shift), "i int, j int, n double, sx double, sy double, sxy double, sxx double, syy double") \
               .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    ok = (F.col("n") > 0) & (vx > F.lit(1e-12) * F.col("sxx")) & (vy > F.lit(1e-12) * F.col("syy"))
    r = sums.select("i", "j", F.when(ok, cov / F.sqrt(vx * vy)).alias("r"))
    at = {c: k for k, c in enumerate(used)}
    cells = df.sparkSession.createDataFrame(
        [(x, y, min(at[x], at[y]), max(at[x], at[y])) for x, y in want], "x string, y string, _i int, _j int")
    # One row per pair of columns on either side.
    return cells.join(F.broadcast(r), (F.col("_i") == F.col("i")) & (F.col("_j") == F.col("j")), "left").select("x", "y", "r")
