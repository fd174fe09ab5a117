"""The list of frequent 5-grams orders the blocks and changes no result."""

import numpy as np

from ruleweave.llm import ngramjoin


def _texts():
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(words[(7 * d + 3 * i) % 400] for i in range(60)) for d in range(12)]
    near = [" ".join(["head", *t.split()[1:]]) for t in base[:8]]
    return [*base, *near, *base[:3], "common common common common common common", None, "", "one two"]


def test_components_do_not_depend_on_the_frequent_elements(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id bigint, text string").repartition(3).cache()
    every = np.unique(np.concatenate([h for b in docs.select("text").toArrow().to_batches() for _, _, _, h in ngramjoin.document_sets(b.column(0))]))
    results = []
    for frequent in (every[:0], every, every[::2]):  # none, all and half of the elements
        monkeypatch.setattr(ngramjoin, "frequent_elements", lambda *a, f=frequent: f)
        results.append(sorted(map(tuple, ngramjoin.jaccard_components(docs).collect())))
    assert results[0] == results[1] == results[2]
    # and the sampled list over the same rows, against all pairs
    monkeypatch.undo()
    assert sorted(map(tuple, ngramjoin.jaccard_components(docs).collect())) == results[0]
    sets = [set() if t is None else {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in _texts()]
    for i, n, comp in results[0]:
        assert n == len(sets[i])
        linked = [j for j in range(len(sets)) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert comp <= min([i, *linked]) and all(results[0][j][2] == comp for j in linked)
    assert len({c for _, _, c in results[0]}) < len(results[0])
