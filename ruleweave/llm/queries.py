"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddups, langid, lexsearch, mixing, ngramjoin, qualityclf, qualityrules, substrdedup, tokencounts, toxicity, urlfilter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@register("op1_url_filters", urlfilter.oracle())
def op1_url_filters(spark, sf_dir):
    """Verdict on every page's URL by the Shift-And automaton of all rules."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "block_glob")


@register("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    """Quality score of every document by the sparse rule ensemble."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(_fold(3) != 1).select("doc_id", "quality")
    model = qualityclf.fit_documents(docs, labels)
    return qualityclf.score_quality(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


@register("op3_ngram_join")
def op3_ngram_join(spark, sf_dir):
    """Set size and component of every document at 5-gram Jaccard 0.8."""
    return ngramjoin.jaccard_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op4_quality_rules", qualityrules.SQL_KEPT)
def op4_quality_rules(spark, sf_dir):
    """Counts and verdict of every document by the threshold table."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return qualityrules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    """Exact histogram of encoded lengths with suffix sums, a row per length."""
    docs = _read(spark, sf_dir, "documents").select("text")
    counted = tokencounts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokencounts.length_report(counted.select("n_tokens"))


@register("op6_embedding_neardups")
def op6_embedding_neardups(spark, sf_dir):
    """Links and components of all embeddings of a label at cosine 0.98."""
    return embeddups.near_duplicates(_read(spark, sf_dir, "embeddings"))


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    """Predicted language of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_fold(5) != 0))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


@register("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    """Words left of every document after the removal of repeated 13-word windows."""
    docs = substrdedup.substring_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op9_source_mixing")
def op9_source_mixing(spark, sf_dir):
    """Slot of every document in the Pfair mixture of the sources."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, block_rows=8)


@register("op10_bpe")
def op10_bpe(spark, sf_dir):
    """Digests of the token ids and of the decoded text of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    lexicon = bpe.build_lexicon(docs, vocabulary)
    return bpe.bpe_encode(docs, vocabulary, lexicon, results=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    """Whitened components of every usable embedding, by the covariance of all distinct ones."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    """Toxicity score of every document by the marginals of the random field."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", "toxic")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels), with_spans=False)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted", "n_spans")


@register("op13_lexical_search", lexsearch.ORACLE)
def op13_lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item, by the two-tree search."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lexsearch.lexical_search(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"))
