"""Input columns named like an operator's own, text ids, and given weights."""

import pytest
from llmdata import awkward_rows, edited, prose
from pyspark.sql import functions as F

from ruleweave.llm import mixing, ngramjoin, qualityrules, substrdedup, urlfilter

#: Names used inside the operators.
OWN = ["_judged", "_t", "_w", "_lines", "_wh", "_h", "_text", "_marks", "_copy", "_cut", "_i", "_mi", "_mh", "id", "h", "first",
       "_source", "_id", "_key", "_tie", "_bucket", "_s", "_b", "_offset", "_in", "_rank", "_ps", "_slots", "_end", "_first", "c0", "c1"]


def _check(plain, crowded):
    extra = {c: f"kept {c}" for c in OWN}
    rows = [r.asDict() for r in crowded.collect()]
    assert rows and all(r[c] == v for r in rows for c, v in extra.items())
    key = lambda r: sorted((k, repr(v)) for k, v in r.items() if k not in extra)
    assert sorted(map(key, rows)) == sorted(key(r.asDict()) for r in plain.collect())


def _crowd(df):
    return df.select("*", *[F.lit(f"kept {c}").alias(c) for c in OWN])


def test_columns_named_like_internal_ones_stay(spark):
    docs = spark.createDataFrame(awkward_rows(), "doc_id long, text string")
    _check(qualityrules.quality_rules(docs), qualityrules.quality_rules(_crowd(docs)))
    _check(substrdedup.substring_dedup(docs), substrdedup.substring_dedup(_crowd(docs)))
    pages = spark.createDataFrame([(1, "http://Example.com/en/x?q"), (2, None), (3, "no scheme")], "page_id long, url string")
    _check(urlfilter.url_filter(pages), urlfilter.url_filter(_crowd(pages)))
    sources = docs.select("doc_id", F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"))
    _check(mixing.mix_sources(sources), mixing.mix_sources(_crowd(sources)))


def test_jaccard_components_of_text_ids(spark):
    base = prose(1, 120)
    texts = {"a10": base, "a2": base, "b": edited(base, 2, 1), "c": edited(base, 3, 2), "d": prose(9, 80), "e": None, "f": "two words"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    numbers = {k: i for i, k in enumerate(sorted(texts))}
    same = spark.createDataFrame([(numbers[k], t) for k, t in texts.items()], "doc_id long, text string")
    got = {numbers[r.doc_id]: (r.n_shingles, numbers[r.component_id]) for r in ngramjoin.jaccard_components(docs).collect()}
    assert got == {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(same).collect()}
    assert got[numbers["b"]][1] == numbers["a10"]


def test_weights_must_fit_the_sources_and_the_period(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(20)], "doc_id long, source string")

    def mixed(rows, **more):
        return mixing.mix_sources(docs, period=10, weights=spark.createDataFrame(rows, "source string, units long"), **more).collect()

    got = mixed([("a", 3), (None, 4), ("a", 1), ("other", 9)])
    assert {r.source: r.mix_units for r in got} == {"a": 4, None: 4} and all(r.mix_slot is not None for r in got)
    for bad in ([("a", 5)], [("a", 5), (None, 0)]):
        with pytest.raises(Exception, match="no unit for source null"):
            mixed(bad)
    with pytest.raises(Exception, match="14 units for a period of 10 slots"):
        mixed([("a", 7), (None, 7)])
    with pytest.raises(ValueError, match="one row or more"):
        mixing.mix_sources(docs, block_rows=0)
