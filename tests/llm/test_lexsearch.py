import math
import re

import numpy as np
from llmdata import awkward_rows, prose

from ruleweave.llm import lexsearch as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _brute(docs, items, k=50):
    bags = []
    for i, t in docs:
        own = _terms(t)
        if own:
            bags.append((i, len(own), {x: own.count(x) for x in set(own)} if len(own) < 2000 else _count(own)))
    nd, total = len(bags), sum(n for _, n, _ in bags)
    df = {}
    for _, _, b in bags:
        for x in b:
            df[x] = df.get(x, 0) + 1
    w = {x: math.floor(1000 * math.log((2 * nd + 2) / (2 * c + 1))) for x, c in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, n, b in bags:
            m = 50 + (50 * n * nd) // total
            s = sum(w[x] * ((10**9 * b[x]) // (1000 * b[x] + 20 * m)) for x in own if x in b)
            if s > 0:
                scored.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scored, key=lambda p: (p[0], p[1] is not None, p[1]))[:k], 1):
            out.append((item, rank, i, -s))
    return sorted(out, key=str)


def _count(own):
    out = {}
    for x in own:
        out[x] = out.get(x, 0) + 1
    return out


def _check(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, item_id string, score string, rank int").repartition(4)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in L.lexical_search(d, q, **kw).collect()), key=str)
    assert got == _brute(docs, items, kw.get("k", 50))
    return got


def test_awkward_texts_equal_brute_force(spark):
    items = [(1, prose(1, 40)), (2, None), (3, ""), (4, "NAÏVE café stone"), (5, "nosuchterm"), (6, "word word WORD"), (1, "extra 東京"), (6, "word"), (None, "the river")]
    assert _check(spark, awkward_rows() + awkward_rows()[-1:], items)
    _check(spark, [(1, None), (2, "&&&")], items)
    assert L.lexical_search(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_ties_copies_and_first_bounds_equal_brute_force(spark):
    docs = [(i, prose(i % 40, 5 + i % 60)) for i in range(600)] + [(1000 + i, prose(3, 30)) for i in range(150)]
    items = [(i, prose(100 + i, 3 + i)) for i in range(30)]
    for first in (10**6, 60):
        got = _check(spark, docs, items, k=7, first_docs=first)
        assert len({r[0] for r in got}) == 30


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_PAIRS", 60)
    docs = [(i, prose(i, 40)) for i in range(120)]
    _check(spark, docs, [(i, prose(300 + i, 25)) for i in range(25)], k=5)


def test_node_pairs_below_the_weakest_score_are_dropped_and_others_kept():
    r = np.random.default_rng(1)
    n_items, v, docs = 37, 90, 333
    item_w = np.where(r.random((n_items, v)) < 0.1, r.integers(1, 9000, v), 0).astype(float)
    leaf_w = np.stack([item_w[i:i + L.ITEM_LEAF].max(axis=0) for i in range(0, n_items, L.ITEM_LEAF)])
    own = r.random((docs, v)) < 0.06
    own[17] = False
    impact = r.integers(1, 10**6, (docs, v)) * own
    off = np.append(0, np.cumsum(own.sum(axis=1)))
    exact = item_w @ impact.T
    for least in (np.zeros(n_items), np.sort(exact, axis=1)[:, -5]):
        i, d, s = L.search_batch(leaf_w, item_w, off, np.nonzero(own)[1], impact[own].astype(float), least)
        want = {(a, b): exact[a, b] for a, b in zip(*np.nonzero((exact >= least[:, None]) & (exact > 0)))}
        assert dict(zip(zip(i.tolist(), d.tolist()), s.tolist())) == want
