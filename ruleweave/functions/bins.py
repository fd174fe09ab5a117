"""Binning (A11, A12, A13, A14).

All bins are right-closed, ``(lo, hi]``, as R's ``cut``.  Spark's
``Bucketizer`` and ``width_bucket`` are left-closed and would move every
value that sits on a break into the next bin, so they are not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_stats(df: DataFrame, stats: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Attach per-group statistics to every row by a scalar subquery (computed
    once, injected as a value): a struct without groups, a map from group key to
    statistics with groups.  Rows are neither joined nor shuffled, so a group
    with most of the rows is no hot key.  For few groups (data sets × models);
    with thousands, join the statistics instead."""
    g = list(group_cols)
    if g:
        names = [c for c in stats.columns if c not in g]
        m = stats.select(F.map_from_entries(F.collect_list(F.struct(
            F.struct(*g).alias("k"), F.struct(*names).alias("v")))).alias("_m")).scalar()
        found = df.withColumn("_stats", F.try_element_at(m, F.struct(*g)))
        return found.withColumns({c: F.col("_stats").getField(c) for c in names}).drop("_stats")
    s = stats.select(F.struct(*stats.columns).alias("_s")).scalar()
    return df.withColumns({c: s.getField(c) for c in stats.columns})

# The risk bins used throughout the analysis.
RISK_BREAKS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
RISK_LABELS = ["20%", "40%", "60%", "80%", "100%"]


def _fixed_bins(col: str | Column, breaks: Sequence[float], values: Sequence,
                include_lowest: bool = False) -> Column:
    # A plain CASE chain with literal results.  (Looking a label up with
    # element_at(array, <nullable index>) is avoided: a NULL index there was
    # seen to give wrong labels after optimisation.)
    x = F.col(col) if isinstance(col, str) else col
    expr = None
    for i in range(1, len(breaks)):
        lo, hi = F.lit(float(breaks[i - 1])), F.lit(float(breaks[i]))
        cond = (x > lo) & (x <= hi)
        if include_lowest and i == 1:
            cond = (x >= lo) & (x <= hi)
        v = F.lit(values[i - 1])
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


def fixed_bin_index(col: str | Column, breaks: Sequence[float],
                    include_lowest: bool = False) -> Column:
    """1-based index of the right-closed interval holding the value;
    NULL outside ``(breaks[0], breaks[-1]]`` (or NULL input)."""
    return _fixed_bins(col, breaks, list(range(1, len(breaks))), include_lowest).cast("int")


def fixed_bin_label(col: str | Column, breaks: Sequence[float] = RISK_BREAKS,
                    labels: Sequence[str] = RISK_LABELS, include_lowest: bool = False) -> Column:
    """A11 with labels: ``cut(p, c(0,.2,.4,.6,.8,1), labels=…)``."""
    return _fixed_bins(col, breaks, list(labels), include_lowest)


def equal_width_bins(df: DataFrame, col: str, k: int, group_cols: Sequence[str] = (),
                     out: str = "bin") -> DataFrame:
    """``cut(x, k)`` – k equal-width right-closed bins over the observed
    range; the outer breaks move out by range/1000 so the minimum falls in
    bin 1.  Min/max per group come from one aggregate, looked up per row.  A constant column uses R's rule:
    width |x|/1000 (or 1/1000 at 0) around the value – every row in bin
    ceil(k/2)."""
    g = list(group_cols)
    rng = df.groupBy(*g).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx")) if g else \
        df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    joined = attach_stats(df, rng, g)
    x = F.col(col).cast("double")
    mn, mx = F.col("_mn").cast("double"), F.col("_mx").cast("double")
    dx = mx - mn
    # constant column: breaks spread over [v - |v|/1000, v + |v|/1000]
    cdx = F.when(mn != 0, F.abs(mn)).otherwise(F.lit(1.0))
    lo_c = mn - cdx / 1000
    step_c = ((mx + cdx / 1000) - lo_c) / k
    const_bin = F.lit(0)
    reg_bin = F.lit(0)
    for i in range(1, k):
        reg_bin = reg_bin + F.when(x > mn + F.lit(i) * (dx / k), 1).otherwise(0)
        const_bin = const_bin + F.when(x > lo_c + F.lit(i) * step_c, 1).otherwise(0)
    idx = F.when(x.isNull(), None).when(dx == 0, const_bin + 1).otherwise(reg_bin + 1)
    return joined.withColumn(out, idx.cast("int")).drop("_mn", "_mx")


def quantile_breaks(df: DataFrame, col: str, k: int, group_cols: Sequence[str] = (),
                    exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """A13 helper: the k+1 quantile breaks per group (R type 7).  Exact mode
    uses histogram refinement (``operators.quantiles``): no group's distinct
    values are gathered in one buffer.  ``exact=False``: ``percentile_approx``."""
    from ..operators.quantiles import exact_quantiles
    g = list(group_cols)
    probs = [i / k for i in range(k + 1)]
    if exact:
        return exact_quantiles(df, col, probs, g, out="breaks")
    src = df.filter(F.col(col).isNotNull())
    agg = F.percentile_approx(F.col(col), F.array(*[F.lit(p) for p in probs]), accuracy) \
        .alias("breaks")
    return src.groupBy(*g).agg(agg) if g else src.agg(agg)


def equal_count_bins(df: DataFrame, col: str, k: int, group_cols: Sequence[str] = (),
                     out: str = "bin", exact: bool = True, strict: bool = True) -> DataFrame:
    """``cut_number(x, k)`` – bins at the k-quantiles, right-closed with
    the lowest value included.  Unlike ``ntile``, ties never straddle bins.
    ``strict``: fail at run time (``raise_error``) if two breaks coincide, as
    the original does; otherwise the coinciding bins are left empty."""
    g = list(group_cols)
    br = quantile_breaks(df, col, k, g, exact)
    joined = attach_stats(df, br, g)
    x = F.col(col).cast("double")
    interior = F.slice(F.col("breaks"), 2, k - 1)
    idx = F.lit(1) + F.size(F.filter(interior, lambda b: b < x))
    idx = F.when(x.isNotNull(), idx)
    if strict:
        idx = F.when(F.size(F.array_distinct(F.col("breaks"))) < F.size(F.col("breaks")),
                     F.raise_error(F.lit("equal_count_bins: breaks are not unique"))
                     ).otherwise(idx)
    return joined.withColumn(out, idx.cast("int")).drop("breaks")
