"""Token counts: an exact histogram of encoded lengths answers every limit.

Documents are encoded in the tasks; Spark aggregates them by encoded length,
and suffix sums over the lengths give, for every context limit L, the number
of documents and tokens above it and the tokens left when texts are cut at L
(``truncated_tokens(L) = tokens of lengths <= L + L * documents longer than L``).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

_ENCODINGS: dict = {}

#: Lengths per bucket of the two-level suffix sums.
BUCKET = 1024


def _encoding(path: str, pattern: str):
    """The tiktoken encoding of a vocabulary file, once per Python worker."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add each row's number of tokens (null and empty texts: 0).  Whole texts
    are encoded; strings of special tokens are ordinary text.  A column named
    like ``out`` is replaced, all others stay."""
    @F.arrow_udf("bigint")
    def count(text: pa.Array) -> pa.Array:
        enc = _encoding(vocabulary, pattern)
        return pa.array(np.fromiter((len(enc.encode_ordinary(x)) if x else 0 for x in text.to_pylist()), np.int64, len(text)))

    small_batches(docs.sparkSession)
    return docs.withColumn(out, count(F.col(f"`{text_col}`")))


def length_report(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per distinct length, taken as a context limit.

    Columns: n_tokens (the limit), n_docs of exactly that length, docs_upto,
    tokens_upto, docs_over, tokens_over, truncated_tokens (all texts cut at
    the limit), quantile (share of documents no longer than the limit; the
    q-quantile of lengths is the first row with quantile >= q) and total_docs,
    total_tokens.  Null lengths are left out, ties share a row, an empty table
    gives an empty report.  The sums run in two levels (inside buckets of
    lengths, then over bucket totals), so no task holds all lengths; rows
    before the aggregation are summed map-side.
    """
    n = F.col(f"`{length_col}`")
    hist = lengths.where(n.isNotNull()).groupBy(n.cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    # written, as it is used twice: documents are encoded once
    hist = Scratch(lengths.sparkSession, "tokencounts").write(hist.withColumn("_b", F.floor(F.col("n_tokens") / BUCKET)), "histogram")
    part = hist.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = part.select(
        "_b", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(everything).alias("total_docs"), F.sum("_t").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("_b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = (hist.withColumns({"_di": F.sum("n_docs").over(inside), "_ti": F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)})
           .join(part, "_b")
           .withColumns({"docs_upto": F.col("_d0") + F.col("_di"), "tokens_upto": F.col("_t0") + F.col("_ti")}))
    return out.select(
        "n_tokens", "n_docs", "docs_upto", "tokens_upto",
        (F.col("total_docs") - F.col("docs_upto")).alias("docs_over"),
        (F.col("total_tokens") - F.col("tokens_upto")).alias("tokens_over"),
        (F.col("tokens_upto") + F.col("n_tokens") * (F.col("total_docs") - F.col("docs_upto"))).alias("truncated_tokens"),
        (F.col("docs_upto") / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens")


def at_limits(report: DataFrame, limits: DataFrame, limit_col: str = "context") -> DataFrame:
    """Answers for any context limits from the report, one row per distinct
    limit that is not null: the totals of the largest length that is not over
    the limit (none: zero), with texts cut at the limit itself.  Limits and
    lengths meet in one table, in which the last sums before a limit are carried
    forward in two levels, as in the report; limits below the shortest length
    and an empty report get their rows too."""
    asked = limits.select(F.col(f"`{limit_col}`").cast("long").alias("context")).where("context IS NOT NULL").distinct()
    known = report.select(F.col("n_tokens").alias("context"), "docs_upto", "tokens_upto", F.lit(0).alias("_asked"))
    none = F.lit(None).cast("long")
    rows = known.unionByName(asked.select("context", none.alias("docs_upto"), none.alias("tokens_upto"), F.lit(1).alias("_asked")))
    rows = rows.withColumn("_b", F.floor(F.col("context") / BUCKET))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = Window.partitionBy("_b").orderBy("context", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    # the sums never fall with the length, so the last one is the largest
    part = rows.groupBy("_b").agg(F.max("docs_upto").alias("_d"), F.max("tokens_upto").alias("_t"))
    part = part.select("_b", *[F.coalesce(F.max(c).over(w), F.lit(0)).alias(name) for c, w, name in (
        ("_d", before, "_d0"), ("_t", before, "_t0"), ("_d", everything, "_docs"), ("_t", everything, "_tokens"))])
    out = rows.withColumns({"_di": F.max("docs_upto").over(inside), "_ti": F.max("tokens_upto").over(inside)}).where("_asked = 1").join(part, "_b")
    out = out.withColumns({"docs_upto": F.coalesce("_di", "_d0"), "tokens_upto": F.coalesce("_ti", "_t0")})
    out = out.withColumns({"docs_over": F.col("_docs") - F.col("docs_upto"), "tokens_over": F.col("_tokens") - F.col("tokens_upto")})
    return out.select("context", "docs_upto", "tokens_upto", "docs_over", "tokens_over",
                      (F.col("tokens_upto") + F.col("context") * F.col("docs_over")).alias("truncated_tokens"))
