"""Exact, seeded, stratified sampling and splits.

All samplers rank rows inside their stratum by a seeded hash order and keep
the first k.  An exact rank is usually a ``row_number()`` over the stratum,
but a stratum may hold a third of the table (a 0/1 target has two), and a
window partition is processed by one task.  So the rank is computed in
pieces:

1. the hash order is cut into B *range buckets* (a monotone map of the hash);
2. rows per (stratum, bucket) are counted – a small table, strata × B rows;
3. a cumulative sum over that small table gives each bucket's offset;
4. ``offset + row_number()`` within (stratum, bucket) is the exact rank.

Each window partition then holds about 1/B of a stratum.  When only the
first k ranks are needed, whole buckets whose offset is ≥ k are dropped
before the window.  The hash of (key, seed) makes the sample independent of
partitioning and input order (``rand(seed)`` is not).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_buckets

_TWO64 = 18446744073709551616.0


def hash_order(key_cols: Sequence[str], seed: int | Column) -> tuple[Column, tuple[float, float]]:
    """Default order: xxhash64 of the key and the seed, with its value range."""
    s = seed if isinstance(seed, Column) else F.lit(int(seed))
    return F.xxhash64(*[F.col(c) for c in key_cols], s), (-_TWO64 / 2, _TWO64 / 2)


def modular_order(key_col: str, seed: int | Column,
                  modulus: int = 1000003) -> tuple[Column, tuple[float, float]]:
    """An order other engines can reproduce exactly with integer arithmetic:
    ``((key mod p) · m) mod p`` with a seed-dependent multiplier
    ``m = 1 + (7918 + 104729 · seed) mod (p − 1)`` (p prime, so every seed gives
    a permutation of the key residues; ties are broken by the key)."""
    s = seed if isinstance(seed, Column) else F.lit(int(seed))
    m = F.lit(1) + F.pmod(F.lit(7918) + F.lit(104729) * s.cast("bigint"), F.lit(modulus - 1))
    k = F.pmod(F.col(key_col).cast("bigint"), F.lit(modulus))
    return F.pmod(k * m, F.lit(modulus)), (0.0, float(modulus))


def modular_order_sql(key: str, seed_sql: str, modulus: int = 1000003) -> str:
    """The same order as DuckDB SQL text (non-negative keys)."""
    return (f"((({key} % {modulus}) * (1 + (7918 + 104729 * ({seed_sql})) % {modulus - 1}))"
            f" % {modulus})")


def _default_buckets(df: DataFrame) -> int:
    return default_buckets(df, 64)


def rank_within(df: DataFrame, strata: Sequence[str], order: Column,
                order_range: tuple[float, float], tie_cols: Sequence[str],
                n_buckets: int | None = None, max_rank: int | Column | None = None,
                rank_col: str = "_rank", size_col: str = "_n") -> DataFrame:
    """Add the exact 1-based rank of each row in its stratum by
    (order, tie_cols), and the stratum size.  With ``max_rank`` only rows of
    rank ≤ max_rank are guaranteed to be kept (others may be dropped early).
    """
    g = list(strata)
    B = n_buckets or _default_buckets(df)
    lo, hi = order_range
    u = (order.cast("double") - F.lit(lo)) / F.lit(hi - lo)
    b = F.least(F.greatest(F.floor(u * F.lit(B)), F.lit(0)), F.lit(B - 1)).cast("int")
    x = df.withColumn("_ord", order).withColumn("_b", b)
    counts = x.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wcum = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*g)
    offsets = counts.select(*g, "_b",
                            F.coalesce(F.sum("_cnt").over(wcum), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(wall).alias(size_col))
    if max_rank is not None:
        mr = max_rank if isinstance(max_rank, Column) else F.lit(int(max_rank))
        offsets = offsets.filter(F.col("_off") < mr)
    j = x.join(offsets, g + ["_b"], "inner")
    w = Window.partitionBy(*g, "_b").orderBy("_ord", *tie_cols)
    return (j.withColumn(rank_col, F.col("_off") + F.row_number().over(w))
            .drop("_ord", "_b", "_off"))


def stratified_split(df: DataFrame, strata: Sequence[str], prop: float, key: str = "case_id",
                     seed: int = 69, order: tuple[Column, tuple[float, float]] | None = None,
                     out: str = "split", n_buckets: int | None = None) -> DataFrame:
    """M1: exact stratified split; ``floor(prop · n)`` rows of each stratum go to
    'train', the rest to 'test' (``prop`` is the train share)."""
    o, rng = order or hash_order([key], seed)
    r = rank_within(df, strata, o, rng, [key], n_buckets)
    k = F.floor(F.lit(float(prop)) * F.col("_n"))
    return (r.withColumn(out, F.when(F.col("_rank") <= k, F.lit("train")).otherwise(F.lit("test")))
            .drop("_rank", "_n"))


def stratified_fraction(df: DataFrame, strata: Sequence[str], fraction: float,
                        key: str = "case_id", seed: int = 69,
                        order: tuple[Column, tuple[float, float]] | None = None,
                        n_buckets: int | None = None) -> DataFrame:
    """M2: ``round(fraction · n)`` rows of each stratum (R rounds half to
    even – ``bround``).  Exact, unlike ``sampleBy`` which is Bernoulli."""
    o, rng = order or hash_order([key], seed)
    r = rank_within(df, strata, o, rng, [key], n_buckets)
    k = F.bround(F.lit(float(fraction)) * F.col("_n"), 0)
    return r.filter(F.col("_rank") <= k).drop("_rank", "_n")


def stratified_n(df: DataFrame, strata: Sequence[str], n: int, key: str = "case_id",
                 seed: int = 69, order: tuple[Column, tuple[float, float]] | None = None,
                 n_buckets: int | None = None) -> DataFrame:
    """M3: n rows per stratum (all rows of a smaller stratum)."""
    o, rng = order or hash_order([key], seed)
    r = rank_within(df, strata, o, rng, [key], n_buckets, max_rank=n)
    return r.filter(F.col("_rank") <= n).drop("_rank", "_n")


def replicated_samples(df: DataFrame, strata: Sequence[str], sizes: Sequence[int],
                       replicates: int, key: str = "case_id", seed: int = 69,
                       modular: bool = False, n_buckets: int | None = None,
                       ) -> DataFrame:
    """M5: the learning-curve grid – for every replicate r (its own seed,
    seed + r) and size n, the first n rows per stratum in the replicate's
    order.  One rank per replicate serves all sizes: the sizes are a filter
    on the rank (``explode(filter(sizes, n -> rank <= n))``), and buckets
    beyond the largest size are pruned before the window.
    Output: the input columns + ``replicate`` + ``n_per_stratum``."""
    reps = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(replicates)))).alias("replicate"))
    s = F.lit(int(seed)) + F.col("replicate")
    o, rng = modular_order(key, s) if modular else hash_order([key], s)
    r = rank_within(reps, list(strata) + ["replicate"], o, rng, [key], n_buckets,
                    max_rank=max(sizes))
    size_arr = F.array(*[F.lit(int(v)) for v in sizes])
    return (r.select("*", F.explode(F.filter(size_arr, lambda n: F.col("_rank") <= n))
                     .alias("n_per_stratum"))
            .drop("_rank", "_n"))


def temporal_sets(df: DataFrame, date_col: str, train_before: str, future_from: str,
                  short_until: str, horizon_days: int = 0, tag: str = "dataset") -> DataFrame:
    """M4: one row per case and data set it belongs to – ``train_pool`` (starts
    ``horizon_days`` or more before ``train_before``, so that its outcome is
    known by then), ``short_term`` (``future_from`` to ``short_until``, both
    included) and ``mid_term`` (from ``future_from`` on).  The future sets
    overlap; cases in none, or without a date, have no row.  A projection next
    to the scan, no shuffle."""
    d = F.to_date(F.col(date_col))
    day = lambda s: F.lit(s).cast("date")
    sets = F.array_compact(F.array(
        F.when(F.date_add(d, int(horizon_days)) < day(train_before), F.lit("train_pool")),
        F.when((d >= day(future_from)) & (d <= day(short_until)), F.lit("short_term")),
        F.when(d >= day(future_from), F.lit("mid_term"))))
    return df.select("*", F.explode(sets).alias(tag))


def exclude(df: DataFrame, other: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``other`` (left anti join)."""
    return df.join(other.select(key), key, "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (left semi join)."""
    return df.join(ids.select(key), key, "left_semi")
