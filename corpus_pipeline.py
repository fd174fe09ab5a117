"""From documents to token ids: the stages of the corpus pipeline.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.  ``ids must be unique``; a null, empty or
letterless text is dropped by the first stage, and nothing else is: the predicted
language decides about no row.  So no later stage sees an empty text.
An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleweave.llm import bpe, langid, mixing, ngramjoin, substrdedup
from ruleweave.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter: only letterless texts have no language.  Where
    none could be learned (no labelled text), every text is called ``und`` and
    those with a letter stay.  A document without a ``lang`` gets the predicted
    one; labelled ones keep theirs."""
    model = langid.fit(docs)
    found = langid.identify(docs, model)
    told = F.col("lang_pred") != langid.UNDETERMINED if model.families else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    known = F.coalesce(F.col("lang"), F.when(F.col("lang_pred") != langid.UNDETERMINED, F.col("lang_pred")))
    return found.where(told).withColumn("lang", known).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near copies."""
    found = ngramjoin.jaccard_components(docs.select("doc_id", "text"))
    first = found.where("doc_id = component_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word passages of earlier ones.  Texts that lose
    nothing stay as they are, others keep their words joined by a blank; a
    document that loses every word goes."""
    cut = substrdedup.substring_dedup(docs)
    left = cut.where("n_words = 0 OR n_removed < n_words")
    left = left.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the mixture of the sources serves
    them (targets n ** 0.7).  No document is dropped: once small sources have
    run out, the rest of the large ones follows in their slots.  The written
    part files hold that order by their names and rows, from which the last stage
    takes each document's place."""
    return mixing.mix_sources(docs, block_rows=8).orderBy("mix_slot", "doc_id").select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and the decoded text,
    and ``mix_rank``: its place (from 0) in the order of the mixture, which is that
    of the part files of ``docs`` and of their rows (null for other tables)."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    lexicon = bpe.build_lexicon(docs, vocabulary)
    encoded = bpe.bpe_encode(_placed(docs), vocabulary, lexicon, results=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return encoded.select("doc_id", "source", "lang", "mix_rank", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


def _placed(docs: DataFrame) -> DataFrame:
    """Add mix_rank: the rows of the part files before a row's own, and its place there."""
    if not docs.inputFiles():
        return docs.withColumn("mix_rank", F.lit(None).cast("bigint"))
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    sizes = docs.select(part.alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # a row per file
    rows = docs.select("*", part.alias("part"), F.col("_metadata.row_index").alias("at"))
    return rows.join(F.broadcast(starts), "part").withColumn("mix_rank", F.col("start") + F.col("at")).drop("part", "start", "at")


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("bpe", bpe_encoding),
]

#: SQL can express neither the trained stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = tmp.write(stage(spark, docs, sf_dir), name)
        tmp.drop(docs)
        docs = done
    return docs
