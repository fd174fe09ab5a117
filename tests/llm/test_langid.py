from llmdata import awkward_rows, prose

from conftest import SF_SMALL
from ruleweave.llm import langid as L


def test_held_out_accuracy_and_undetermined(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    model = L.fit(docs.where("doc_id % 5 <> 0"))
    assert set(model.families) == {"germanic", "romance"}
    held = L.identify(docs.where("doc_id % 5 = 0"), model)
    assert held.where("lang_pred = lang").count() / held.count() >= 0.97
    odd = spark.createDataFrame([(i, t, 1) for i, t in awkward_rows()], "doc_id long, text string, score int")
    for r in L.identify(odd, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1
        if letters:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    assert L.identify(odd.limit(0), model).count() == 0


def test_few_or_no_languages(spark):
    df = spark.createDataFrame([(1, "guten tag", "de"), (2, "x y", None), (3, None, "en"), (4, "123", None)], "doc_id long, text string, lang string")
    one = {r.doc_id: r.lang_pred for r in L.identify(df, L.fit(df.where("doc_id <> 3"))).collect()}
    assert one == {1: "de", 2: "de", 3: "und", 4: "und"}
    none = L.identify(df, L.fit(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_unlisted_languages_are_families_of_their_own(spark):
    rows = [(i, "zzq qqz " * (i % 9 + 2), "qq") for i in range(30)] + [(100 + i, "the of and " * (i % 9 + 2), "en") for i in range(30)] \
        + [(200 + i, "der und die " * (i % 9 + 2), "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert set(model.families) == {"germanic", "=qq"}
    assert L.identify(df, model).where("lang_pred <> lang").count() == 0


def test_copies_of_a_text_do_not_fill_or_empty_the_sample(spark, monkeypatch):
    rows = [("the copied text of all", "en")] * 4000 + [(f"the of and {prose(i, 12)}", "en") for i in range(400)] \
        + [(f"der und die {prose(i, 12)}", "de") for i in range(400)]
    df = spark.createDataFrame(rows + [("123", "xx"), ("456", "yy")], "text string, lang string")
    write, seen = L.Scratch.write, []

    def spy(self, table, step):
        out = write(self, table, step)
        seen.append({r.lang: r["count"] for r in out.groupBy("lang").count().collect()})
        return out

    monkeypatch.setattr(L.Scratch, "write", spy)
    for seed in (1, 2):
        assert set(L.fit(df, per_language=200, seed=seed).families) == {"germanic"}
    assert len(seen) == 2 and all(set(n) == {"en", "de"} and 150 <= min(n.values()) <= max(n.values()) <= 250 for n in seen)
