import random

import pytest
from llmdata import awkward_rows, edited, prose

from ruleweave.llm import substrdedup as S


def _brute(rows):
    import re
    first = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def _got(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept_text string, id int")
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(df).collect())


def test_awkward_texts(spark):
    rows = awkward_rows()
    assert _got(spark, rows) == _brute(rows)


@pytest.mark.parametrize("shard", [8192, 8])
def test_passages_and_near_copies(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    r, rows = random.Random(9), []
    passages = [prose(50 + i, n) for i, n in enumerate((12, 13, 14, 40, 120))]
    for i in range(60):
        parts = [prose(700 + i, r.randrange(0, 40))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            parts += [edited(p, r.randrange(10**9), r.randrange(0, 2)), prose(r.randrange(10**9), r.randrange(0, 25))]
        rows.append((r.randrange(10**9), "\n".join(parts)))
    rows += [(r.randrange(10**9), rows[k][1]) for k in (1, 1, 5)] + [(5, "w " * 60), (6, "w " * 45)]
    assert _got(spark, rows) == _brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = prose(3, 60)
    rows = [(4, t), (4, t), (9, t), (4, prose(8, 30))]
    assert _got(spark, rows) == _brute(rows)
    df = spark.createDataFrame([(None, t), (None, t), (7, t)], "doc_id long, text string")
    assert [r.n_removed for r in S.substring_dedup(df).collect()] == [0, 0, 0]
    assert S.substring_dedup(df.limit(0)).count() == 0


def test_automaton_knows_the_smallest_id():
    r = random.Random(5)
    a, seen = S.SuffixAutomaton(), {}
    for doc in range(1, 120):
        w = [r.choice("ab") for _ in range(r.randrange(5, 25))]
        bits, known = a.match(w, doc, 5)
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        assert bits == sum(1 << k for k, x in enumerate(windows) if seen.get(x, doc) < doc)
        assert known == sum(x in seen for x in windows)
        a.add(w, doc)
        for x in windows:
            seen.setdefault(x, doc)
