import os
import re

from conftest import SF_SMALL
from llmdata import awkward_rows
from test_neardups import _brute_jaccard
from test_substrdedup import _brute

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in rows], SCHEMA)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    kept = P.language_id(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows == {r.doc_id: r.text for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    left = P.ngram_join(spark, kept, SF_SMALL)
    comp = _brute_jaccard(list(rows.items()))
    rows2 = {r.doc_id: r.text for r in left.collect()}
    assert rows2 == {i: t for i, t in rows.items() if comp[i][1] == i}
    cut = {r.doc_id: (r.text, r.n_chars) for r in P.substring_dedup(spark, left, SF_SMALL).collect()}
    want = {}
    for i, n, gone, text in _brute(list(rows2.items())):
        if n == 0 or gone < n:
            t = text if gone else rows2[i]
            want[i] = (t, len(t))
    assert {i: v[0] for i, v in cut.items()} == {i: v[0] for i, v in want.items()}
    mixed = P.source_mixing(spark, P.substring_dedup(spark, left, SF_SMALL), SF_SMALL)
    assert mixed.columns == docs.columns and mixed.count() == len(cut)


def test_run_and_awkward_rows(spark, tmp_path):
    out = P.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "source", "lang", "mix_rank", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted(r.mix_rank for r in out.collect()) == list(range(out.count()))
    assert out.where("n_tokens <> size(ids)").count() == 0 and out.count() > 0
    for name, rows in (("odd", awkward_rows()), ("empty", [])):
        _table(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        n = P.run(spark, str(tmp_path / name)).count()
        assert (n == 0) == (name == "empty")


def test_mixing_keeps_every_row_in_the_order_of_a_brute_force_schedule(spark):
    sizes = {"hot": 803, **{f"s{i:02d}": 80 for i in range(20)}}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, f"t{i}", "en", s, 2) for i, s in enumerate(names)], SCHEMA)
    got = P.source_mixing(spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    # targets: one slot of 1,000 each, the others by largest remainders of n ** 0.7
    power = {s: n ** 0.7 for s, n in sizes.items()}
    share = {s: p / sum(power.values()) * (1000 - len(sizes)) for s, p in power.items()}
    units = {s: 1 + int(x) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s))[:1000 - sum(units.values())]:
        units[s] += 1
    place = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(9, doc_id) AS h").collect()}
    left = {s: sorted((i for i, x in enumerate(names) if x == s), key=place.get) for s in sizes}
    want, nxt, t = [], dict.fromkeys(sizes, 0), 0
    while any(left.values()):
        ready = [(-(-(nxt[s] + 1) * 1000 // u), s) for s, u in units.items() if nxt[s] * 1000 // u <= t]
        if ready:
            s = min(ready)[1]
            nxt[s] += 1
            want += sorted(left[s][:8])
            left[s] = left[s][8:]
        t += 1
    assert [r.doc_id for r in got.collect()] == want and len(want) == len(names)


def test_documents_stay_when_no_language_is_labelled(spark):
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in awkward_rows()], SCHEMA)
    got = {r.doc_id for r in P.language_id(spark, docs, SF_SMALL).collect()}
    assert got == {i for i, t in awkward_rows() if t and re.search(r"[^\W\d_]", t)} and got


def test_last_table_holds_the_order_of_the_mixture_and_every_language(spark, tmp_path):
    rows = [(i, f"the river of stone {i} " * 3, None if i % 4 == 0 else "en", "hot" if i < 60 else f"s{i % 5}", 9) for i in range(100)]
    rows += [(100 + i, f"der fluss und die stadt {i} " * 3, None if i % 4 == 0 else "de", "hot", 9) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    told = P.language_id(spark, docs, SF_SMALL)
    lang = {r.doc_id: r.lang for r in told.collect()}
    assert len(lang) == 200 and all(lang[i] == ("en" if i < 100 else "de") for i in lang)
    mixed = P.source_mixing(spark, told, SF_SMALL)
    order = [r.doc_id for r in mixed.collect()]
    mixed.write.parquet(str(tmp_path / "mixed"))
    out = P.bpe_encoding(spark, spark.read.parquet(str(tmp_path / "mixed")), SF_SMALL)
    got = {r.mix_rank: r.doc_id for r in out.collect()}
    assert [got[i] for i in range(200)] == order and order != sorted(order)
    assert P.bpe_encoding(spark, docs, SF_SMALL).where("mix_rank IS NOT NULL").count() == 0
