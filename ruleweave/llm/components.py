"""Connected components of a table of links, by alternating star contractions
(all in joins and aggregates; a hub's links are never gathered in one place)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(low, "u").where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u")
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, tmp: Scratch) -> DataFrame:
    """(id, component) for every id that occurs in a link (a, b) with another
    id; component is the smallest id reachable.  Repeated links, either order
    and links to itself are fine.  Every round is written to the shared folder."""
    e = tmp.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == state or not state.n:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        last = state
        new = tmp.write(_small_star(_large_star(e)), "links")
        tmp.drop(e)
        e = new
