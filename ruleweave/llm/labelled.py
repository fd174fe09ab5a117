"""A bounded sample of labelled texts, taken without moving texts through a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_PLACES = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, tmp: Scratch, seed: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, weight): of the texts labelled 0 or 1, about ``per_label`` of
    each label, all of a rarer one; equal (text, label) rows count once.

    ``weight`` is the number of distinct labelled texts that a row of its label
    stands for.  Null texts count as empty ones; rows whose id is null or has no
    label are left out.  Only ids and text hashes are joined and shuffled; the
    ids taken, about twice ``per_label``, are broadcast to fetch their texts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("label IN (0.0, 1.0)").distinct()
    folded = tmp.write(keyed.select("id", "h").join(known, "id").groupBy("h", "label").agg(F.min("id").alias("id")), "labelled")
    counts = {r.label: r.n for r in folded.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_label / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(_PLACES)) / F.lit(float(_PLACES))
    chosen = folded.where(place < share).withColumn("weight", F.try_divide(F.lit(1.0), share))
    found = keyed.join(F.broadcast(chosen), ["id", "h"]).select("text", "label", "weight", "h")
    sample = tmp.write(found.dropDuplicates(["h", "label"]).select("text", "label", "weight"), "texts")
    tmp.drop(folded)
    return sample
