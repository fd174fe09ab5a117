"""Exact quantiles (R type 7 / Spark ``percentile``) without a per-group
buffer of all distinct values.

Spark's exact ``percentile`` keeps a map of every distinct value of a group
in one aggregation buffer – one task per group, memory ∝ distinct values.
Here the order statistics are found by histogram refinement:

1. (group, value, count) – a partial aggregate (ties collapse);
2. per group n and approximate quantiles of its distinct values (small); they
   cut the group into B buckets of about equally many distinct values, wherever
   these lie, and the counts per (group, bucket) form a small table;
3. a cumulative sum over that table locates the bucket holding each needed
   order statistic (ranks ⌊h⌋ and ⌈h⌉ of h = (n−1)·p + 1);
4. only the (value, count) rows of those few buckets are ranked (window per
   (group, bucket) over distinct values with running counts), and the values
   at the needed ranks are read off and interpolated as Spark does:
   (hi − pos)·x_lo + (pos − lo)·x_hi, or x_lo itself when x_lo = x_hi.

No step holds a whole group; heavy ties cost one row per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import attach_stats
from ..session import materialize

N_BUCKETS = 128


def value_counts_table(df: DataFrame, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    g = list(group_cols)
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*g, F.col(value).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))


def bucketed(counts: DataFrame, group_cols: Sequence[str], n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """(per-group _n, the count table with _n and a bucket number _b that never
    falls as the value rises)."""
    g = list(group_cols)
    cuts = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    rng = (counts.groupBy(*g) if g else counts.groupBy()).agg(
        F.sum("_c").alias("_n"), F.percentile_approx("_v", cuts, F.lit(20 * n_buckets)).alias("_edges"))
    b = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    return rng.select(*g, "_n"), attach_stats(counts, rng, g).withColumn("_b", b).drop("_edges")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), n_buckets: int | None = None,
                    counts: DataFrame | None = None, out: str = "q") -> DataFrame:
    """(group…, ``out`` array<double>) – the type-7 quantiles for ``probs``.
    ``counts`` may be given as an existing (group…, _v, _c) table.  The count
    table feeds several branches below, so it is written once to the shared
    folder (eagerly) unless it was passed in."""
    g = list(group_cols)
    B = int(n_buckets or N_BUCKETS)
    vc = counts if counts is not None else \
        materialize(value_counts_table(df, value, g), "quantile-counts")
    rng, cb = bucketed(vc, g, B)

    per_b = cb.groupBy(*g, "_b", "_n").agg(F.sum("_c").alias("_bc"))
    wb = (Window.partitionBy(*g).orderBy("_b") if g else Window.orderBy("_b")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("_before", F.coalesce(F.sum("_bc").over(wb), F.lit(0)))
    # needed 1-based ranks: floor(pos)+1 and ceil(pos)+1, pos = (n-1)·p
    needs = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        needs.append(F.struct(F.lit(i).alias("k"), F.lit("lo").alias("side"),
                              (F.floor(pos) + 1).cast("long").alias("rank")))
        needs.append(F.struct(F.lit(i).alias("k"), F.lit("hi").alias("side"),
                              (F.ceil(pos) + 1).cast("long").alias("rank")))
    targets = (per_b.select(*g, "_b", "_before", "_bc", F.inline(F.array(*needs)))
               .filter((F.col("rank") > F.col("_before"))
                       & (F.col("rank") <= F.col("_before") + F.col("_bc")))
               .select(*g, "_b", "k", "side", (F.col("rank") - F.col("_before")).alias("_lr")))

    sel = cb.join(targets.select(*g, "_b").distinct(), g + ["_b"], "left_semi")
    wv = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sel = sel.withColumn("_hi", F.sum("_c").over(wv)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    picked = (sel.join(targets, g + ["_b"], "inner")
              .filter((F.col("_lr") > F.col("_lo")) & (F.col("_lr") <= F.col("_hi")))
              .groupBy(*g, "k").agg(F.max(F.when(F.col("side") == "lo", F.col("_v"))).alias("_xl"),
                                    F.max(F.when(F.col("side") == "hi", F.col("_v"))).alias("_xh")))
    picked = attach_stats(picked, rng, g)
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    pos = (F.col("_n") - 1).cast("double") * F.element_at(p_arr, F.col("k") + 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    # equal neighbours: the value itself (no interpolation round-off)
    q = F.when((lo == hi) | (F.col("_xl") == F.col("_xh")), F.col("_xl")).otherwise(
        (hi - pos) * F.col("_xl") + (pos - lo) * F.col("_xh"))
    qs = picked.select(*g, "k", q.alias("_q"))
    agg = (qs.groupBy(*g) if g else qs.groupBy()).agg(
        F.array_sort(F.collect_list(F.struct("k", "_q"))).alias("_s"))
    return agg.select(*g, F.transform("_s", lambda s: s["_q"]).alias(out))
