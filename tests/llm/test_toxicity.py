import itertools
import math

import numpy as np
from conftest import SF_SMALL
from llmdata import awkward_rows, prose

from ruleweave.llm import toxicity as X

SF = SF_SMALL.replace("0.001", "0.01")


def _brute(emit, trans, start):
    """(P(tag 1), P(neighbours), log Z) of one chain by all tag sequences."""
    n = len(emit)
    total, one, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        s = start * tags[0] + sum(e * t for e, t in zip(emit, tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:]))
        w = math.exp(s)
        total += w
        one += w * np.array(tags)
        for t in range(1, n):
            pair[t, tags[t - 1], tags[t]] += w
    return one / total, pair / total, math.log(total)


def test_marginals_equal_all_sequences(monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setattr(X, "_BLOCK", 3)
    sizes = [1, 7, 2, 9, 1, 1, 5]
    emit, trans, start = r.normal(size=sum(sizes)) * 3, r.normal(size=(2, 2)), 0.7
    first = np.cumsum([0, *sizes])[:-1]
    p, pair, log_z = X.marginals(emit, first, trans, start)
    want = [_brute(emit[a:a + n], trans, start) for a, n in zip(first, sizes)]
    assert np.allclose(p, np.concatenate([w[0] for w in want]))
    assert math.isclose(log_z, sum(w[2] for w in want))
    for a, n, w in zip(first, sizes, want):
        assert np.allclose(pair[a + 1:a + n], w[1][1:])


def test_long_chain_stays_finite():
    emit = np.full(200_000, -800.0)
    emit[::3] = 900.0
    p, _, log_z = X.marginals(emit, np.array([0, 70_001]), np.array([[0.0, -1.0], [2.0, 0.5]]), 0.0)
    assert np.isfinite(p).all() and np.isfinite(log_z) and p[0] > 0.99 and p[1] < 0.01


def test_gradient_equals_differences():
    r = np.random.default_rng(4)
    n, first = 40, np.array([0, 11, 12, 30])
    word, kind, tag = r.integers(0, 60, n), r.integers(0, 4, n), r.integers(0, 2, n)
    weight = np.repeat([1.0, 3.0, 1.0, 3.0], np.diff(np.append(first, n)))
    w = r.normal(size=X.SIZE) * 0.5
    f, g = X.loss_and_gradient(w, word, kind, tag, first, weight)
    places = [*word[:6], X.WORDS + word[3], 2 * X.WORDS + word[7], *range(X._AT_KIND, X.SIZE)]
    for i in places:
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        d = (X.loss_and_gradient(up, word, kind, tag, first, weight)[0] - X.loss_and_gradient(down, word, kind, tag, first, weight)[0]) / 2e-5
        assert abs(d - g[i]) < 1e-4 * max(1, abs(d))


def _labelled(spark, n=500):
    rows = [(i, prose(i, 30 + i % 50), 0) for i in range(n)]
    for i in range(n // 4):
        w = prose(9000 + i, 40).split()
        w[i % 40] = ("nitwit", "Dolt!", "vermin###")[i % 3]
        rows.append((n + i, " ".join(w), 1))
    return rows, spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, score string"), \
        spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_spans_and_scores(spark):
    rows, docs, labels = _labelled(spark)
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.score_toxicity(docs, model).collect()}
    wrong = sum(got[i].predicted != y for i, _, y in rows)
    assert wrong <= 0.01 * len(rows)
    for i, t, y in rows:
        r = got[i]
        assert 0 <= r.score <= 1 and r.n_spans == len(r.spans)
        for s in r.spans:
            assert t[s.start:s.end].lower() in {"nitwit", "dolt", "vermin"} and s.score >= 0.5
    new = spark.createDataFrame([(1, "café \U0001f600 the vermin of stone"), (2, "the river of stone")], "doc_id long, text string")
    a, b = X.score_toxicity(new, model).orderBy("doc_id").collect()
    assert (a.predicted, b.predicted, b.spans) == (1, 0, []) and (a.spans[0].start, a.spans[0].end) == (11, 17)


def test_awkward_texts_and_few_labels(spark):
    _, docs, labels = _labelled(spark, 120)
    odd = spark.createDataFrame([(i, t, "x", "y") for i, t in awkward_rows()], "doc_id long, text string, row string, d string")
    models = [X.fit(docs, labels), X.fit(docs, labels.where("toxic = 0")), X.fit(docs, labels.limit(0))]
    for m in models:
        got = X.score_toxicity(odd, m)
        assert got.columns == ["doc_id", "text", "row", "d", "score", "predicted", "n_spans", "spans"]
        assert got.where("score is null or score < 0 or score > 1 or row <> 'x' or d <> 'y'").count() == 0
        assert got.count() == len(awkward_rows())
        assert X.score_toxicity(odd.limit(0), m).count() == 0
    assert X.score_toxicity(odd, models[1]).where("predicted = 1").count() == 0
    repeated = X.fit(docs.union(docs), labels.union(labels))
    assert np.allclose(repeated.weights, models[0].weights)


def test_held_out_toxic_documents(spark):
    from ruleweave.llm.queries import QUERIES
    got = QUERIES["op12_toxicity"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    n = held.count()
    assert held.where("predicted = toxic").count() / n > 0.93
    assert held.where("predicted = 1 and toxic = 0").count() <= 0.03 * n


def test_sample_keeps_a_rare_label_and_folds_copies(spark):
    from ruleweave.llm.labelled import labelled_sample
    from ruleweave.llm.scratch import Scratch
    docs = spark.createDataFrame([(i, "one text") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(2000)] + [(9000, None)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id IN (5003, 9000) THEN 1 WHEN doc_id = 5004 THEN NULL ELSE 0 END AS y")
    got = labelled_sample(docs, labels, "y", 100, Scratch(spark, "t")).collect()
    assert sorted(r.text for r in got if r.label == 1.0) == ["", "t3"]
    zero = [r for r in got if r.label == 0.0]
    assert 60 <= len(zero) <= 140 and len({r.text for r in zero}) == len(zero)
    assert abs(zero[0].weight - 1999 / 100) < 1e-9
