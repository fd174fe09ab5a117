"""Streaming rule counts resume from their checkpoint after a restart."""

from pyspark.sql import functions as F

from ruleweave.functions.rules import rule
from ruleweave.session import scratch_path
from ruleweave.streaming.scoring import last_result, run_complete_to_parquet, rule_counts_from_files, stream_hits, stream_rule_counts


SCHEMA = "rule_id string, n bigint, n_event bigint"


def test_many_rules_and_an_empty_source(spark):
    rules = [rule(f"R{i:03}", ("x", ">", float(i % 12))) for i in range(131)]
    src = scratch_path(spark, "src")
    rows = spark.range(40).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    rows.repartition(5).write.parquet(src)
    got = {r.rule_id: r.n for r in rule_counts_from_files(spark, src, rows.schema, rules, files_per_batch=2).collect()}
    assert got == {f"R{i:03}": 4 * max(0, 9 - i % 12) for i in range(131)}
    hits = stream_hits(spark.readStream.schema(rows.schema).parquet(src), rules, ["y"])
    assert hits.isStreaming
    empty = scratch_path(spark, "src")
    rows.limit(0).write.parquet(empty)
    none = rule_counts_from_files(spark, empty, rows.schema, rules)
    assert none.count() == 131 and none.where("n <> 0").count() == 0


def test_counts_resume_from_checkpoint(spark):
    rules = [rule("A", ("x", ">", 5)), rule("B", ("x", "<=", 2))]
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    batch = spark.range(10).select((F.col("id") % 10).cast("double").alias("x"),
                                   (F.col("id") % 2).cast("int").alias("y"))
    schema = batch.schema
    batch.write.mode("append").parquet(src)

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = run_complete_to_parquet(stream_rule_counts(s, rules), out, ckpt)
        rows_read = sum(p["numInputRows"] for p in q.recentProgress)
        return {r.rule_id: (r.n, r.n_event) for r in last_result(spark, out, q, SCHEMA).collect()}, rows_read

    first, read1 = run()
    assert first == {"A": (4, 2), "B": (3, 2)} and read1 == 10
    batch.write.mode("append").parquet(src)   # new data lands; the job restarts
    second, read2 = run()
    assert second == {"A": (8, 4), "B": (6, 4)}
    assert read2 == 10  # only the new file was read: the counts came back from state
