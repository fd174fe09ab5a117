from llmdata import awkward_rows, prose
from pyspark.sql import functions as F

from ruleweave.llm import qualityclf as C
from ruleweave.llm import qualityrules as R


def _brute(text):
    import re
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules_equal_brute_force(spark):
    rows = awkward_rows()
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows + rows[-1:]], "doc_id long, text string, n_words int, kept string")
    got = R.quality_rules(df).collect()
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for r in got:
        want = _brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert R.quality_rules(df.limit(0)).count() == 0


def test_quality_rules_run_no_python(spark):
    df = spark.createDataFrame(awkward_rows(), "doc_id long, text string")
    plan = R.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rule_ensemble_learns_and_compiles(spark):
    good = [(i, prose(i, 60 + i % 90), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(i, 60).split()), 0) for i in range(150)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = C.fit(df.where("doc_id % 3 <> 0"))
    assert model.rules or model.linear
    held = C.score_quality(df.where("doc_id % 3 = 0"), model)
    assert held.where("predicted = quality").count() / held.count() > 0.97
    assert held.where("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(i, t, "x") for i, t in awkward_rows()], "doc_id long, text string, score string")
    assert C.score_quality(odd, model).where("score is null or predicted is null or score < 0 or score > 1").count() == 0
    assert C.score_quality(odd.limit(0), model).count() == 0


def test_quality_classifier_without_labels_or_with_one(spark):
    df = spark.createDataFrame([(1, "a b c", None), (2, None, None)], "doc_id long, text string, quality int")
    assert [r.predicted for r in C.score_quality(df, C.fit(df)).collect()] == [1, 1]
    one = df.withColumn("quality", F.lit(0))
    assert [r.predicted for r in C.score_quality(one, C.fit(one)).collect()] == [0, 0]


def test_held_out_accuracy_on_documents(spark):
    from conftest import SF_SMALL
    from ruleweave.llm.queries import QUERIES
    got = QUERIES["op2_quality_classifier"](spark, SF_SMALL.replace("0.001", "0.01"))
    labels = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() / held.count() >= 0.95


def test_copies_of_a_text_do_not_fill_or_empty_the_sample(spark, monkeypatch):
    rows = [("one copied text", 1)] * 4000 + [(prose(i, 20), 1) for i in range(300)] + [(prose(i, 20) + " ###", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "text string, quality int")
    write, seen = C.Scratch.write, []

    def spy(self, table, step):
        out = write(self, table, step)
        if step == "sample":
            seen.append(out.count())
        return out

    monkeypatch.setattr(C.Scratch, "write", spy)
    for seed in (1, 2):
        C.fit(df, sample_rows=200, seed=seed)
    assert len(seen) == 2 and all(150 <= n <= 250 for n in seen)
