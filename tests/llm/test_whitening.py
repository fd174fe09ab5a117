import numpy as np
import pytest

from ruleweave.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def _brute(rows, components=16):
    """{(id, component): (n, deviation, whitened, explained)} in plain numpy."""
    ok = [(i, np.floor(64 * np.array(v)).astype(int) + 1_000_000) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v) and v]
    lens = {}
    for x in {tuple(x) for _, x in ok}:
        lens[len(x)] = lens.get(len(x), 0) + 1
    d = max(lens, key=lambda k: (lens[k], k))
    ok = [(i, x) for i, x in ok if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in ok}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in ok:
        dev = int(((n * x - s) ** 2).sum())
        for k in range(min(components, d)):
            out[i, k + 1] = (n, dev, float((x - s / n) @ u[:, k] / np.sqrt(e[k])) if e[k] > 1e-9 else None, float(e[k] / e.sum()))
    return out


def test_rows_equal_plain_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6) * np.arange(1, 7)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)]  # copies
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5),
             (2004, []), (2005, [1.0, 2.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(5)
    got = W.whiten(df, components=4).collect()
    want = _brute(rows, 4)
    assert len(got) == 4 * sum(1 for i, v in rows if i < 2000)
    assert {(g.vec_id, g.component) for g in got} == set(want)
    sign = {}
    for g in got:
        n, dev, white, explained = want[g.vec_id, g.component]
        assert (g.n, g.deviation) == (n, dev)
        assert g.explained == pytest.approx(explained, rel=1e-9)
        if abs(white) > 1e-6:
            s = sign.setdefault(g.component, np.sign(white * g.whitened))
            assert g.whitened * s == pytest.approx(white, rel=1e-9, abs=1e-9)
        assert g.identity_error < 1e-9


def test_clustered_eigenvalues_are_refined():
    r = np.random.default_rng(5)
    for gaps in ([1.0, 1.0, 1.0, 0.5], [1, 1 - 1e-9, 1 - 2e-9, 0.3], [1, 1 - 1e-7, 0.2, 0.2 - 1e-12], [5.0, 0, 0, 0]):
        e = np.array([*gaps, *(0.1 / np.arange(1, 29))])
        q = np.linalg.qr(r.normal(size=(32, 32)))[0]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        value, x = W.refined_eigen(v)
        assert np.all(np.diff(value) <= 1e-18)
        assert np.abs(x.T @ x - np.eye(32)).max() < 5e-15
        assert np.abs(v @ x - x * value).max() < 5e-15
        assert value == pytest.approx(np.sort(e)[::-1], abs=1e-14)
    first = np.linalg.eigh(v.astype(np.float32))[1]
    assert np.abs(v @ first - first * value[::-1]).max() > 1e-9  # what the refinement mends


def test_near_eigenvalues_keep_their_own_vectors():
    """Vectors of eigenvalues 1e-9 apart, whose subspace is known exactly."""
    v = np.diag([3.0, 2.0, 1.0])
    h = np.array([[0, 0, 0], [0, 0, 0], [0, 0, 0.0]])
    value, x = W.refined_eigen(np.block([[v, h], [h, np.diag([2.0 - 1e-9, 0.5, 0.25])]]))
    assert value.tolist() == [3.0, 2.0, 2.0 - 1e-9, 1.0, 0.5, 0.25]
    assert np.abs(np.abs(x).max(axis=0) - 1).max() < 1e-15


def test_degenerate_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], "a", "b"), (1, [1.0, 2.0], "a", "b"), (None, [1.0, 2.0], "a", "b")], SCHEMA)
    got = W.whiten(one).collect()
    assert len(got) == 6
    assert all(g.n == 1 and g.deviation == 0 and g.whitened is None and g.explained is None and g.identity_error == 0 for g in got)
    two = spark.createDataFrame([(1, [0.0, 0.0, 0.0], "a", "b"), (2, [3.0, 4.0, 0.0], "a", "b")], SCHEMA)
    rows = {(g.vec_id, g.component): g for g in W.whiten(two).collect()}
    assert len(rows) == 6 and abs(abs(rows[1, 1].whitened) - 1) < 1e-12 and rows[1, 2].whitened is None
    assert W.whiten(one.limit(0)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, "a", "b"), (2, [], "a", "b")], SCHEMA)).count() == 0


def test_huge_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0]), (4, [1e6, 5.0])]
    got = W.whiten(spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)).collect()
    assert len(got) == 8 and any(g.deviation is None for g in got)
    assert all(g.whitened is None or np.isfinite(g.whitened) for g in got)


def test_packing_round_trip():
    m = np.array([[0, 127], [0, 128], [-40_000, 5], [1 << 40, -1]], dtype=np.int64)
    b = W.pack(m)
    assert [x[0] for x in b] == [1, 2, 4, 8]
    import pyarrow as pa
    assert sorted(map(tuple, W.unpack(pa.array(b), 2).tolist())) == sorted(map(tuple, m.tolist()))
