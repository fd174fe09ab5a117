"""The data behind density plots.

Rows are reduced by partial aggregation to bins or to the grid's kernel sums,
so what is shuffled is bounded by groups × grid size, whatever the row count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import attach_stats
from ..session import materialize


def histogram_density(df: DataFrame, group_cols: Sequence[str], value: str,
                      lo: float | None = None, hi: float | None = None, k: int = 20) -> DataFrame:
    """Histogram as density, k equal-width right-closed bins over
    [lo, hi] (lo included in bin 1; by default the range of all values):
    density = count / (n · width), n = rows in [lo, hi] of the group (values
    outside a given range are left out).  Only non-empty bins are returned."""
    g = list(group_cols)
    x = F.col(value).cast("double")
    if lo is None or hi is None:
        ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()  # two numbers
        lo = ends.lo if lo is None else lo
        hi = ends.hi if hi is None else hi
        if lo is None or lo == hi:
            lo, hi = (lo or 0.0) - 0.5, (hi or 0.0) + 0.5
    width = (hi - lo) / k
    idx = F.least(F.greatest(F.ceil((x - F.lit(lo)) / F.lit(width)), F.lit(1)), F.lit(k)).cast("int")
    src = df.filter(x.isNotNull() & (x >= lo) & (x <= hi)).withColumn("bin", idx)
    counts = src.groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))
    tot = (counts.groupBy(*g) if g else counts.groupBy()).agg(F.sum("count").alias("_n"))
    j = attach_stats(counts, tot, g)
    return j.select(*g, "bin",
                    (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("x_lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("x_hi"),
                    F.col("count").cast("bigint").alias("count"),
                    (F.col("count") / (F.col("_n") * F.lit(width))).alias("density"))


def kde_grid(df: DataFrame, group_cols: Sequence[str], value: str, lo: float | None = None,
             hi: float | None = None, n_grid: int = 64, bandwidth: float | None = None,
             cells_per_bandwidth: int | None = None) -> DataFrame:
    """Gaussian kernel density on an evenly spaced grid of ``n_grid``
    points over [lo, hi] (by default the group's range and three bandwidths to
    either side), with bandwidth ``bw.nrd0`` per group unless given:
    0.9 · min(sd, IQR/1.34) · n^(-1/5).

    The density is the direct kernel sum over the (group, value, count) table:
    every row adds its ``n_grid`` kernel values to sums that are aggregated
    map-side, so only groups × grid numbers are shuffled.  With
    ``cells_per_bandwidth`` (32 gives about 5 digits) the values are first
    binned linearly into cells of that fraction of the bandwidth, which bounds
    the rows of a very large table by its range.  NULL and NaN values are left
    out; values outside [lo, hi] count, where they are.
    """
    from .quantiles import exact_quantiles, value_counts_table
    g = list(group_cols)

    def per(d: DataFrame):
        return d.groupBy(*g)

    src = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = materialize(value_counts_table(src, value, g), "kde-counts")  # feeds the branches below
    first = per(counts).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                            (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean"))
    spread = per(attach_stats(counts, first, g)).agg(  # centred, so nothing cancels
        F.max("_n").cast("bigint").alias("n"), F.max("_min").alias("_min"), F.max("_max").alias("_max"),
        F.sqrt(F.try_divide(F.sum(F.col("_c") * F.pow(F.col("_v") - F.col("_mean"), F.lit(2.0))),
                            (F.max("_n") - 1).cast("double"))).alias("_sd"))
    iqr = exact_quantiles(src, value, [0.25, 0.75], g, counts=counts, out="_q")
    stats = attach_stats(spread, iqr, g)
    if bandwidth is None:
        s = F.least(F.col("_sd"), (F.col("_q")[1] - F.col("_q")[0]) / F.lit(1.34))
        s = F.when(s > 0, s).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
        bw = F.lit(0.9) * s * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    else:
        bw = F.lit(float(bandwidth))
    stats = stats.withColumn("bandwidth", bw)
    low = F.lit(float(lo)) if lo is not None else F.col("_min") - 3 * F.col("bandwidth")
    high = F.lit(float(hi)) if hi is not None else F.col("_max") + 3 * F.col("bandwidth")
    stats = stats.select(*g, "n", "bandwidth", low.alias("_lo"),
                         ((high - low) / F.lit(n_grid - 1)).alias("_step"))
    rows = attach_stats(counts.withColumnRenamed("_c", "_w"), stats, g)
    if cells_per_bandwidth:
        width = F.col("bandwidth") / F.lit(cells_per_bandwidth)
        at = F.floor(F.col("_v") / width)
        part = F.col("_v") / width - at
        rows = rows.select(*g, "n", "bandwidth", "_lo", "_step", F.inline(F.array(
            F.struct((at * width).alias("_v"), ((1 - part) * F.col("_w")).alias("_w")),
            F.struct(((at + 1) * width).alias("_v"), (part * F.col("_w")).alias("_w")))))
        rows = rows.groupBy(*g, "n", "bandwidth", "_lo", "_step", "_v").agg(F.sum("_w").alias("_w"))

    def kernel(i: int):
        z = (F.col("_lo") + F.lit(float(i)) * F.col("_step") - F.col("_v")) / F.col("bandwidth")
        return F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias(f"_k{i}")

    sums = rows.groupBy(*g, "n", "bandwidth", "_lo", "_step").agg(*[kernel(i) for i in range(n_grid)])
    out = sums.select(*g, "n", "bandwidth", "_lo", "_step",
                      F.posexplode(F.array(*[F.col(f"_k{i}") for i in range(n_grid)])).alias("grid_index", "_k"))
    return out.select(*g, "grid_index",
                      (F.col("_lo") + F.col("grid_index") * F.col("_step")).alias("x"),
                      (F.col("_k") * F.lit(1 / math.sqrt(2 * math.pi)) / (F.col("n") * F.col("bandwidth"))).alias("density"),
                      "bandwidth")
