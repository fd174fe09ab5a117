"""Mixing sources to target weights by Pfair scheduling, in Spark SQL only.

Time is a sequence of slots, one block of ``block_rows`` documents each.  A
source with weight w = units / period owns block j (from 0) from its release
``floor(j / w)`` until its deadline ``ceil((j + 1) / w)``; in every slot, of the
sources whose next block is released, the one with the earliest deadline is
served (ties: the first name).  The weights add up to one, so every block lies
inside its window, and after any number t of slots a source has had less than
one block more or less than w * t.

The schedule repeats after ``period`` slots.  One period is computed by one
``aggregate`` expression over the slot numbers on a one-row table; block j of a
source then lies in the slot given by j's place in the period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import set_aside

#: Slots of a period for up to so many sources; more sources get a multiple of it.
PERIOD = 1000


def target_units(sizes: DataFrame, alpha: float, period: int | None) -> DataFrame:
    """(source, n, units, period): weights proportional to n ** alpha as whole
    units that add up to ``period`` (the least multiple of ``PERIOD`` that gives
    every source a slot, where none is given), one at least each (largest
    remainders, ties by name).  ``sizes`` has a row per source."""
    w = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw = sizes.withColumn("_p", F.pow("n", F.lit(float(alpha))))
    if period is None:
        raw = raw.withColumn("period", (F.ceil(F.count(F.lit(1)).over(w) / F.lit(PERIOD)) * PERIOD).cast("long"))
    else:
        too_many = F.raise_error(F.lit(f"more than {period} sources for a period of {period} slots"))
        raw = raw.withColumn("period", F.lit(period).cast("long"))
        raw = raw.withColumn("_p", F.when(F.count(F.lit(1)).over(w) <= period, F.col("_p")).otherwise(too_many))
    raw = raw.withColumn("_share", F.col("_p") / F.sum("_p").over(w) * (F.col("period") - F.count(F.lit(1)).over(w)))
    raw = raw.withColumn("_base", F.floor("_share"))
    raw = raw.withColumn("_left", F.col("period") - F.count(F.lit(1)).over(w) - F.sum("_base").over(w))
    order = Window.orderBy(F.desc(F.col("_share") - F.col("_base")), F.asc_nulls_first("source"))
    units = 1 + F.col("_base") + F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)
    return raw.select("source", "n", units.cast("long").alias("units"), "period")


def given_units(sizes: DataFrame, weights: DataFrame, period: int) -> DataFrame:
    """(source, n, units, period) with the units of ``weights`` (source, units;
    rows of one source add up).  Fails where a source has no unit, or where the
    sources' units add up to more than the period."""
    right = weights.groupBy(F.col("source").alias("_ws")).agg(F.sum(F.col("units").cast("long")).alias("_u"))
    held = sizes.join(right, sizes["source"].eqNullSafe(right["_ws"]), "left")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("_u").over(everything)
    none = F.raise_error(F.concat(F.lit("no unit for source "), F.coalesce(F.col("source").cast("string"), F.lit("null"))))
    over = F.raise_error(F.concat(total.cast("string"), F.lit(f" units for a period of {period} slots")))
    units = F.when(F.coalesce(F.col("_u"), F.lit(0)) < 1, none).when(total > period, over).otherwise(F.col("_u"))
    return held.select("source", "n", units.cast("long").alias("units"), F.lit(period).cast("long").alias("period"))


def _deadline(j: Column, units: Column, period: Column) -> Column:
    """ceil((j + 1) * period / units), in whole numbers."""
    return F.floor(((j + 1) * period + units - 1) / units)


def period_schedule(units: DataFrame, period: int | None = None) -> DataFrame:
    """(source, unit, slot): for every source and each of its blocks in one
    period, the slot of the period that serves it.  ``units`` holds the
    targets of all sources (their number is at most the period) and, where no
    ``period`` is given, the period in a column of this name.  The work is
    slots times sources, in one row."""
    slots = F.max("period") if period is None else F.max(F.lit(period).cast("long"))
    row = units.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source"), F.col("units")))).alias("src"), slots.alias("period"))
    p = F.col("period")
    row = row.where(F.size("src") > 0).withColumn("src", F.transform("src", lambda s, i: F.struct(i.alias("i"), s["source"].alias("source"), s["units"].alias("units"))))

    start = F.struct(F.transform("src", lambda s: F.lit(0).cast("long")).alias("next"),
                     F.array().cast("array<struct<i:int,unit:bigint,slot:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        state = F.transform("src", lambda s: F.struct(
            _deadline(F.get(acc["next"], s["i"]), s["units"], p).alias("deadline"), s["i"].alias("i"), s["units"].alias("units"),
            F.get(acc["next"], s["i"]).alias("j")))
        # released: floor(j * period / units) <= t, and a block left in this period
        ready = F.filter(state, lambda s: (s["j"] < s["units"]) & (F.floor(s["j"] * p / s["units"]) <= t))
        best = F.array_min(F.transform(ready, lambda s: F.struct(s["deadline"].alias("deadline"), s["i"].alias("i"), s["j"].alias("j"))))
        # an array of one, so that the best source is found once a slot
        return F.get(F.transform(F.array(best), lambda b: F.struct(
            F.transform(acc["next"], lambda j, i: F.when(i == b["i"], j + 1).otherwise(j)).alias("next"),
            F.when(b.isNull(), acc["out"]).otherwise(
                F.concat(acc["out"], F.array(F.struct(b["i"].alias("i"), b["j"].alias("unit"), t.alias("slot"))))).alias("out"))), F.lit(0))

    done = row.select("src", F.aggregate(F.sequence(F.lit(0), (p - 1).cast("int")), start, step)["out"].alias("out"))
    flat = done.select("src", F.explode("out").alias("o"))
    return flat.select(F.get("src", F.col("o.i"))["source"].alias("source"), F.get("src", F.col("o.i"))["units"].alias("units"),
                       F.col("o.unit").alias("unit"), F.col("o.slot").cast("long").alias("slot"))


def numbered(docs: DataFrame, id_col: str, source_col: str, seed: int) -> DataFrame:
    """Add ``_rank``: each row's place (from 0) in its source, in seeded order.

    The order's range is cut into buckets; ranks run inside (source, bucket)
    and a small table of bucket totals adds the rows before, so a source with
    most rows is spread over all buckets."""
    spark = docs.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    # repeated ids share their place; ties within them are broken by the row's hash
    df = docs.withColumns({"_key": key, "_tie": F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])})
    df = df.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor((F.col("_key") / F.lit(2.0 ** 64) + F.lit(0.5)) * F.lit(buckets))).cast("int"))
    totals = df.groupBy(F.col(source_col).alias("_s"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_s", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(source_col, "_bucket").orderBy("_key", "_tie")
    ranked = df.withColumn("_in", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, ranked[source_col].eqNullSafe(offsets["_s"]) & (ranked["_bucket"] == offsets["_b"]), "left")
    return joined.withColumn("_rank", F.col("_offset") + F.col("_in")).drop("_key", "_tie", "_bucket", "_s", "_b", "_offset", "_in")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 1,
                alpha: float = 0.7, period: int | None = None, seed: int = 9, weights: DataFrame | None = None,
                max_missing: float = 0.1) -> DataFrame:
    """Add ``mix_slot`` (the slot that serves the row's block), ``mix_units``
    (the source's target in blocks per ``period`` slots), ``in_mix`` and
    ``on_target`` to every row.

    Targets come from ``weights`` (source, units that add up to ``period``;
    with fewer, slots stay empty; a source of ``docs`` without a unit and units
    beyond the period raise an error, other sources' rows are ignored) or are
    n ** alpha.  ``block_rows`` is one or more.  ``on_target`` holds up to the slot in which the first source
    lacks a whole block: until there the mixture follows the targets to less
    than one block at every slot.  ``in_mix`` goes on until sources with more
    than ``max_missing`` of the targets have run out: sources that still have
    blocks follow their targets to less than one block, but the slots of those
    that have run out stay empty, so their deviation grows with every period.
    No row is dropped or repeated.  A null source is a source of its own;
    repeated ids keep one place each, in an order made by the row's hash; an
    empty table gives an empty result; other columns stay (those named like a
    result are replaced).  Without a ``period`` it is 1,000 slots (with
    ``weights``: always), or for more sources the next multiple; a given one
    raises an error when there are more sources.
    """
    results = {"mix_slot", "mix_units", "in_mix", "on_target"}
    cols = [c for c in docs.columns if c not in results]
    if block_rows < 1:
        raise ValueError("a block has one row or more")
    aside, back = set_aside(cols)
    base = docs.select(*aside, F.col(f"`{source_col}`").alias("_source"), F.col(f"`{id_col}`").alias("_id"))
    sizes = base.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        units = target_units(sizes, alpha, period)
    else:
        units = given_units(sizes, weights, period or PERIOD)
    schedule = period_schedule(units)
    blocks = F.ceil(F.col("n") / F.lit(block_rows))
    slots = schedule.groupBy(F.col("source").alias("_ss"), F.col("units").alias("_su")).agg(
        F.array_sort(F.collect_list(F.struct("unit", "slot"))).alias("_slots"))
    per = units.join(slots, units["source"].eqNullSafe(slots["_ss"])).withColumnRenamed("period", "_period")

    def slot_of(j: Column, units: Column) -> Column:
        return (F.floor(j / units) * F.col("_period") + F.get("_slots", F.pmod(j, units).cast("int"))["slot"]).cast("long")

    # the slots of the first block that the source no longer has, and no longer has whole
    per = per.select(F.col("source").alias("_ps"), F.col("units").alias("mix_units"), "_period", "_slots", slot_of(blocks, F.col("units")).alias("_out"),
                     slot_of(F.floor(F.col("n") / F.lit(block_rows)), F.col("units")).alias("_short"))
    # units of the sources that are out at each source's end; the first end with too many
    gone = F.sum("mix_units").over(Window.orderBy("_out").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    late = F.when(F.col("_gone") > F.lit(float(max_missing)) * F.col("_period"), F.col("_out"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_gone", gone).withColumns({"_end": F.min(late).over(everything), "_first": F.min("_short").over(everything)})
    rows = numbered(base, "_id", "_source", seed)
    # one row per source
    rows = rows.join(F.broadcast(per), rows["_source"].eqNullSafe(per["_ps"]), "left")
    j = F.floor(F.col("_rank") / F.lit(block_rows))
    rows = rows.withColumn("mix_slot", slot_of(j, F.col("mix_units")))
    return rows.withColumns({"in_mix": F.col("mix_slot") < F.col("_end"), "on_target": F.col("mix_slot") < F.col("_first")}).select(
        *back, "mix_slot", "mix_units", "in_mix", "on_target")
