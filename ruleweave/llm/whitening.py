"""Embedding whitening: eigenvectors of the covariance of all distinct vectors.

Entries are put on a grid (``floor(64 * c) + 1000000``), so equal vectors and
sums are exact.  The covariance is summed in the tasks, one partial matrix each.
Its eigenvectors come from a float32 solver and are corrected by the iteration of
Ogita and Aishima (matrix products in float64, the last steps in long double);
eigenvalues too close together for that iteration are told apart by solving the
shifted problem of their subspace.  Only matrices of the vectors' dimension
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import map_units
from .scratch import Scratch

SCALE, SHIFT = 64, 1_000_000
#: Whitened components of a row.
COMPONENTS = 16
_LIMIT = 1 << 62


# ---------------------------------------------------------------------------
# Grid vectors
# ---------------------------------------------------------------------------

def grid_rows(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of floor(64 * c)) for every length among the vectors
    that are not null and hold finite entries only."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.asarray(col.value_lengths().fill_null(-1))
    flat = col.flatten()
    known = np.asarray(flat.is_valid())
    vals = np.asarray(flat.cast(pa.float64()).fill_null(0.0), dtype=np.float64)
    first = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
    bad = np.append(0, np.cumsum(~known | ~np.isfinite(vals)))
    size = np.maximum(lens, 0)
    ok = (lens >= 0) & (bad[first + size] == bad[first])
    for d in np.unique(lens[ok]):
        rows = np.flatnonzero(ok & (lens == d))
        m = vals[first[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            m = np.floor(np.clip(m * SCALE, -float(_LIMIT), float(_LIMIT)))
        yield rows, m.astype(np.int64)


def pack(m: np.ndarray) -> list[bytes]:
    """A vector as its entries' width in bytes and the entries, the narrowest
    width that holds them: equal vectors, and only they, have equal bytes."""
    out: list[bytes] = [b""] * len(m)
    least, most = (m.min(axis=1), m.max(axis=1)) if m.shape[1] else (np.zeros(len(m), np.int64),) * 2
    todo = np.ones(len(m), bool)
    for w in (1, 2, 4, 8):
        i = np.iinfo(f"<i{w}")
        rows = np.flatnonzero(todo & (least >= i.min) & (most <= i.max))
        todo[rows] = False
        raw, step = m[rows].astype(f"<i{w}").tobytes(), w * m.shape[1]
        for k, r in enumerate(rows):
            out[r] = bytes([w]) + raw[k * step:(k + 1) * step]
    return out


def unpack(col: pa.Array, d: int) -> np.ndarray:
    """Matrix of the packed vectors of length d (others are left out)."""
    parts = []
    by_width: dict[int, list[bytes]] = {}
    for b in col.to_pylist():
        if len(b) == 1 + b[0] * d:
            by_width.setdefault(b[0], []).append(b[1:])
    for w, rows in by_width.items():
        parts.append(np.frombuffer(b"".join(rows), dtype=f"<i{w}").reshape(len(rows), d).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros((0, d), np.int64)


def centred(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """m - sums / n in double precision."""
    if n * int(np.abs(m).max(initial=0)) + max(map(abs, sums), default=0) < _LIMIT:
        return (m * n - np.array(sums, dtype=np.int64)) / float(n)
    return (m.astype(np.longdouble) - np.array([np.longdouble(s) / n for s in sums])).astype(np.float64)


def deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * m - sums) ** 2; null beyond 64 bits."""
    top = n * int(np.abs(m).max(initial=0)) + max(map(abs, sums), default=0)
    if top * top * max(m.shape[1], 1) < _LIMIT:
        d = m * n - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in m.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


# ---------------------------------------------------------------------------
# Eigenvectors
# ---------------------------------------------------------------------------

def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One step of Ogita and Aishima: (better vectors, eigenvalues, which pairs
    are too close to be told apart, size of the correction)."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: np.sqrt((m * m).sum())
    close = 2 * (norm(s - np.diag(value)) + norm(a) * norm(r))
    gap = value[None, :] - value[:, None]
    near = np.abs(gap) <= close
    e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, gap))
    return x + x @ e, value, near, float(np.abs(e).max(initial=0))


def _solve_clusters(a: np.ndarray, x: np.ndarray, value: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Solve the problem of every run of eigenvalues that are close together
    within the run's subspace, shifted by their mean, and turn the vectors."""
    order = np.argsort(-value.astype(np.float64), kind="stable")
    x, start = x.copy(), 0
    for k in range(1, len(order) + 1):
        if k < len(order) and near[order[k - 1], order[k]]:
            continue
        own = order[start:k]
        start = k
        if len(own) < 2:
            continue
        q = x[:, own]
        q = q + q @ (np.eye(len(own), dtype=x.dtype) - q.T @ q) / 2
        t = q.T @ (a @ q - value[own].mean() * q)
        t = ((t + t.T) / 2).astype(np.float64)
        size = np.abs(t).max()
        if size > 0:  # scaled, so that small differences keep all their digits
            q = q @ np.linalg.eigh(t / size)[1].astype(x.dtype)
        x[:, own] = q
    return x


def refined_eigen(v: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric
    matrix, to double precision.  Each vector's largest entry is positive."""
    d = len(v)
    size = np.abs(v).max(initial=0)
    if not d or size == 0:
        return np.zeros(d), np.eye(d)
    v = v / size
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(np.float64)
    for kind, most, enough in ((np.float64, steps, 1e-13), (np.longdouble, 6, 1e-17)):
        a, x = v.astype(kind), x.astype(kind)
        for _ in range(most):
            x, value, near, moved = _step(a, x)
            if near.sum() > d:
                x = _solve_clusters(a, x, value, near)
            elif moved < enough:
                break
    for _ in range(2):  # the corrections' second-order rest
        x = x + x @ (np.eye(d, dtype=x.dtype) - x.T @ x) / 2
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order].astype(np.float64), value[order].astype(np.float64)
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return value * size, x


# ---------------------------------------------------------------------------
# The operator
# ---------------------------------------------------------------------------

def _sum_matrices(fit_list: DataFrame, of, d: int) -> np.ndarray:
    """Sum over all partitions of the d-column matrix ``of`` gives for a batch;
    row i of every partial matrix meets in one place."""
    def run(batches):
        total = None
        for b in batches:
            m = of(b.column(0))
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(t: pa.Table) -> pa.RecordBatch:
        rows = np.asarray(t.column("row").combine_chunks().flatten()).reshape(t.num_rows, -1)
        return pa.RecordBatch.from_arrays([t.column("i").combine_chunks()[:1], pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))], ["i", "row"])

    rows = map_units(fit_list.mapInArrow(run, "i int, row array<double>"), ["i"], "i int, row array<double>", add).collect()
    out = np.zeros((d, d))
    for r in rows:
        out[r.i] = r.row
    return out


class Whitening:
    """What ``fit_whitening`` found: dimension, number of distinct vectors, exact
    sums of grid entries, eigenvalues and vectors of the covariance."""

    def __init__(self, d: int, n: int, sums: list[int], value: np.ndarray, vectors: np.ndarray, trace: float, components: int):
        self.d, self.n, self.sums, self.value, self.trace = d, n, sums, value, trace
        self.k = min(components, d)
        least = max(d, 1) * np.finfo(float).eps * max(float(value[0]) if d else 0.0, 0.0)
        self.known = value[:self.k] > least
        self.project = vectors[:, :self.k] / np.sqrt(np.where(self.known, value[:self.k], 1.0))
        self.explained = [float(v) / trace if trace > 0 else None for v in value[:self.k]]
        self.identity_error = 0.0

    def whiten(self, m: np.ndarray) -> np.ndarray:
        return centred(m, self.n, self.sums) @ self.project


def fit_whitening(df: DataFrame, vec_col: str, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct grid vector once; None without one of a dimension
    of one at least."""
    spark = df.sparkSession
    tmp = Scratch(spark, "whitening")

    def packed(batches):
        for b in batches:
            for _, m in grid_rows(b.column(0)):
                if m.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(pack(m), pa.binary()), pa.array(np.full(len(m), m.shape[1]), pa.int32())], ["x", "d"])

    vectors = df.select(F.col(f"`{vec_col}`").alias("v")).where("v IS NOT NULL")
    every = tmp.write(vectors.mapInArrow(packed, "x binary, d int").distinct(), "fit")
    dims = every.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        tmp.drop(every)
        return None
    d, n = dims.d, dims.n
    own = every.where(F.col("d") == d).select("x")

    def sums(batches):
        total = [0] * d
        for b in batches:
            m = unpack(b.column(0), d)
            part = m.sum(axis=0).tolist() if len(m) * int(np.abs(m).max(initial=0)) < _LIMIT else [sum(c) for c in m.T.tolist()]
            total = [a + p for a, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total], pa.string())], ["i", "s"])

    parts = own.mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    at = {r.i: int(r.s) for r in parts.collect()}
    total = [at[i] for i in range(d)]

    def gram(col):
        c = centred(unpack(col, d), n, total)
        return c.T @ c

    v = _sum_matrices(own, gram, d) / n
    v = (v + v.T) / 2
    model = Whitening(d, n, total, *refined_eigen(v), float(np.trace(v)), components)
    k = model.k

    def white_gram(col):
        z = model.whiten(unpack(col, d))
        z = np.column_stack([z, np.ones(len(z))])
        return z.T @ z

    w = _sum_matrices(own, white_gram, k + 1) / n
    cov = w[:k, :k] - np.outer(w[k, :k], w[k, :k])
    error = np.abs(cov - np.eye(k))[np.ix_(model.known, model.known)]
    model.identity_error = float(error.max(initial=0.0))
    tmp.drop(every)
    return model


def whiten(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every
    row with a usable vector and each of the first components.

    Rows whose vector is null or holds a null or non-finite entry are left out;
    so are vectors of another length than the commonest among distinct vectors
    (the longer of equally common ones) and empty ones.  Repeated rows and
    copies of a vector count once in the fit and each get their rows; ids may
    be null or repeat.  A component without variance (fewer distinct vectors
    than components) has whitened null, and explained is null where all vectors
    are equal.  Entries beyond 2**56 count as that; a deviation beyond 64 bits is
    null.  Only id and vector are read, so other columns may have any name.  An
    empty table gives an empty one.
    """
    spark, ids = df.sparkSession, df.schema[id_col]
    schema = T.StructType([T.StructField(ids.name, ids.dataType)] + T.StructType.fromDDL(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields)
    model = fit_whitening(df, vec_col, components)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)  # of the dimension's size

    def run(batches):
        w = shared.value
        for b in batches:
            for rows, m in grid_rows(b.column(1)):
                if m.shape[1] != w.d:
                    continue
                for i in range(0, len(rows), 2048):
                    part = m[i:i + 2048]
                    take = np.repeat(rows[i:i + 2048], w.k)
                    white = w.whiten(part)
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(take)),
                        pa.array(np.tile(np.arange(1, w.k + 1), n), pa.int32()),
                        pa.array(np.full(n * w.k, w.n), pa.int64()),
                        pa.array(deviations(part, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(n), w.k))),
                        pa.array(white.ravel(), mask=~np.tile(w.known, n)),
                        pa.array(w.explained * n, pa.float64()),
                        pa.array(np.full(n * w.k, w.identity_error)),
                    ], schema.names)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{vec_col}`")).mapInArrow(run, schema)
