"""Rule matching and per-rule risk counts on streaming DataFrames.

Rule matching (J6) and linear rule scoring (R8) are row-wise, so the same
column expressions run on a ``readStream`` source unchanged.  The per-rule
counts are a stateful streaming aggregation (state: one row per rule);
results go through ``foreachBatch`` into a Parquet table in the shared
folder, and the query's checkpoint lives there too, so a restarted job
resumes from the last committed batch (exactly-once output per batch id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import Rule
from ..operators.match import match_rules, rule_score
from ..session import scratch_path


def stream_hits(stream: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """J6 on a stream: (keep…, rule_id) per matched rule."""
    return match_rules(stream, rules, keep=keep)


def stream_scores(stream: DataFrame, rules: Sequence[Rule], coefficients: dict[str, float],
                  intercept: float, keep: Sequence[str]) -> DataFrame:
    """R8 on a stream: P(event) from rule coefficients (no explode)."""
    z = rule_score(rules, coefficients, intercept)
    return stream.select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("prob"))


def stream_rule_counts(stream: DataFrame, rules: Sequence[Rule], event_label: int = 0
                       ) -> DataFrame:
    """Running per-rule counts: n matched, n events."""
    hits = match_rules(stream, rules, keep=("y",))
    return hits.groupBy("rule_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(F.col("y") == F.lit(event_label)).cast("bigint").alias("n_event"))


def run_complete_to_parquet(agg: DataFrame, out_path: str, checkpoint: str,
                            available_now: bool = True):
    """Run a complete-mode aggregation; every micro-batch writes the whole
    result to a folder of its own (a repeated batch rewrites its folder, and
    earlier results stay whole meanwhile).  Returns the finished query (its
    ``recentProgress`` shows what each micro-batch read)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    w = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    q.awaitTermination()
    return q


def rule_counts_from_files(spark: SparkSession, source_dir: str, schema: T.StructType,
                           rules: Sequence[Rule], event_label: int = 0,
                           files_per_batch: int | None = None) -> DataFrame:
    """Stream the Parquet files of ``source_dir`` (in micro-batches of
    ``files_per_batch`` files, by default all that are there), keep the per-rule
    counts, and return the last result, with a row for every rule."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(source_dir)
    out = scratch_path(spark, "stream-rule-counts")
    ckpt = scratch_path(spark, "stream-checkpoint")
    done = run_complete_to_parquet(stream_rule_counts(stream, rules, event_label), out, ckpt)
    every = spark.createDataFrame([(r.rule_id,) for r in rules], "rule_id string")
    counts = last_result(spark, out, done, "rule_id string, n bigint, n_event bigint")
    return every.join(counts, "rule_id", "left").select(
        "rule_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "n_event")])


def last_result(spark: SparkSession, out_path: str, query, schema: str) -> DataFrame:
    """What the last micro-batch wrote; an empty table if there was none (an
    empty source)."""
    last = query.lastProgress
    if not last or last["batchId"] < 0 or not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], schema)
    batch = max(p["batchId"] for p in query.recentProgress if p["numInputRows"])
    return spark.read.parquet(f"{out_path}/batch={batch}")
