import random

import numpy as np
import pytest
from llmdata import awkward_rows, edited, prose

from ruleweave.llm import embeddups as E
from ruleweave.llm import ngramjoin as J
from ruleweave.llm.components import components
from ruleweave.llm.scratch import Scratch


def _closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _brute_jaccard(rows):
    import re
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = _closure(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def _joined(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, component_id int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}


def test_awkward_texts(spark):
    rows = awkward_rows()
    assert _joined(spark, rows) == _brute_jaccard(rows)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_groups_of_near_copies_of_all_sizes(spark, monkeypatch, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    r, rows = random.Random(4), []
    for g in range(24):
        base = prose(100 + g, r.choice([4, 5, 6, 9, 14, 22, 40, 70, 130, 300]))
        for c in range(r.choice([1, 2, 3, 12, 30])):
            rows.append((r.randrange(10**9), edited(base, r.randrange(10**9), r.randrange(0, 1 + len(base.split()) // 18))))
    shared = prose(999, 60)
    rows += [(r.randrange(10**9), shared + " " + prose(5000 + i, 18)) for i in range(40)]  # one passage in many
    assert _joined(spark, rows) == _brute_jaccard(rows)


def test_jaccard_of_empty_table_and_low_threshold(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df).count() == 0
    with pytest.raises(ValueError):
        J.jaccard_components(df, percent=50)


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (3, 40, 400):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 5:], rng.integers(0, 2**63, n // 4).astype(np.uint64)]))
        s = J.bit_sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        apart = int(np.unpackbits(s[0] ^ s[1]).sum())
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {x.id: x.component for x in components(df, Scratch(spark, "t")).collect()}
    want = _closure(range(500), links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def _brute_cosine(rows):
    good = {}
    for i, v, lab in rows:
        if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = (lab, x / np.linalg.norm(x))
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1])
             and float(good[a][1] @ good[b][1]) >= 0.98]
    comp = _closure([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


@pytest.mark.parametrize("chunk", [1024, 16])
def test_embeddings_equal_brute_force(spark, chunk):
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        base = rng.standard_normal(32)
        for c in range([1, 2, 5, 40][g % 4]):
            rows.append((int(rng.integers(10**9)), (base + rng.standard_normal(32) * rng.choice([0, 0.03, 0.12])).astype(np.float32).tolist(), int(g % 3)))
    rows += [(int(rng.integers(10**9)), rng.standard_normal(32).astype(np.float32).tolist(), int(i % 3)) for i in range(100)]
    copy = rng.standard_normal(32).astype(np.float32).tolist()
    rows += [(int(rng.integers(10**9)), copy, 1) for _ in range(50)]
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 32, 1), (4, [float("nan")] * 32, 1), (5, [float("inf")] + [1.0] * 31, 1),
             (6, [None] + [1.0] * 31, 1), (7, copy, None), (8, copy, None), (9, copy[:16], 1), (10, copy[:16], 1), (11, [x * 3 for x in copy], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, chunk=chunk).collect()}
    want = _brute_cosine(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * there
    if found == there:
        assert got == want
    assert E.near_duplicates(df.limit(0)).count() == 0
