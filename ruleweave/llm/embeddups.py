"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into
cells of a width; the cells of ``per_table`` projections make the key of one of
``tables`` hash tables.  Vectors of one label that share a key are compared by
their exact cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import chunk_pairs, map_units
from .scratch import Scratch
from .textops import U64, mix

THRESHOLD = 0.98
#: For a pair at cosine 0.98 (distance 0.2), one projection agrees with
#: probability 0.84 at width 1, a table of 8 with 0.25, one of 24 tables with 0.999.
TABLES, PER_TABLE, WIDTH, CHUNK = 24, 8, 1.0, 1024


def _matrix(col) -> np.ndarray:
    """Vectors of one length as double rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def table_keys(x: np.ndarray, tables: int, per_table: int, width: float, seed: int) -> np.ndarray:
    """keys[row, table] of normalised vectors."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * per_table))
    b = rng.uniform(0, width, tables * per_table)
    cells = np.floor((x @ a + b) / width).astype(np.int64).view(U64).reshape(len(x), tables, per_table)
    h = np.broadcast_to(np.arange(tables, dtype=U64) + U64(1), (len(x), tables))
    for k in range(per_table):
        h = mix(h ^ mix(cells[:, :, k] + U64(k + 1)))
    return h.view(np.int64)


def _links(x, codes, count, ids, chunk, table, threshold):
    """For every row of a unit: the rows it links with here first (weighted by
    their counts), and the smallest id it reaches inside the unit."""
    n = len(x)
    near = (x @ x.T) >= threshold
    np.fill_diagonal(near, False)
    if chunk.min() != chunk.max():  # a unit of two chunks: pairs across only
        near &= chunk[:, None] != chunk[None, :]
    i, j = np.nonzero(near)
    # count a pair in the first table that brings it together
    earlier = np.zeros(len(i), bool)
    for t in range(table):
        earlier |= codes[i, t] == codes[j, t]
    add = np.bincount(i[~earlier], weights=count[j[~earlier]], minlength=n).astype(np.int64)
    reach = ids.copy()
    while len(i):
        low = reach.copy()
        np.minimum.at(low, i, reach[j])
        if (low == reach).all():
            break
        reach = low
    return add, reach


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, tables: int = TABLES, per_table: int = PER_TABLE, width: float = WIDTH,
                    chunk: int = CHUNK, seed: int = 6) -> DataFrame:
    """One row per input row: its id, n_links (other rows with the same label
    and cosine >= threshold that some table brings together), component_id
    (smallest id reachable by links) and kept (it is that id).

    Rows whose label is null, or whose vector is null, empty, zero or has null
    or non-finite components, link with nothing, and vectors of different
    lengths never link.  Exact copies are folded into one class before hashing
    and count as links of each other; a class is named by its smallest id.
    Rows with the same id stay separate rows and link if their vectors do.  An
    empty table gives an empty result; other columns are ignored.  Buckets
    over ``chunk`` vectors are compared as pairs of chunks, so all their pairs
    are still seen and no task holds a whole bucket; pairs are never written
    out.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "embeddups")
    v = F.col(f"`{vector_col}`")
    good = F.coalesce(F.forall(v, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.cast("array<double>").alias("v"),
                          (good & F.col(f"`{label_col}`").isNotNull()).alias("ok"))
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), F.reverse("v")).alias("h2")]
    rows = rows.select("id", "label", "ok", F.when(F.col("ok"), F.col("v")).alias("v"), *digest)
    ids = tmp.write(rows.select("id", "label", "ok", "h1", "h2"), "ids")
    classes = tmp.write(rows.where("ok").groupBy("label", "h1", "h2").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "classes")

    def hash_rows(batches):
        for b in batches:
            sizes = pa.compute.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                keys = table_keys(_unit(_matrix(part.column("v"))), tables, per_table, width, seed)
                # label and length are part of the key
                lab = np.array([hash_label(x) for x in part.column("label").to_pylist()], dtype=U64)
                keys = mix(keys.view(U64) ^ mix(lab + U64(d))[:, None]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n"), part.column("v"),
                     pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))], ["id", "n", "v", "codes"])

    def hash_label(x) -> int:
        import xxhash
        return xxhash.xxh64_intdigest(repr(x))

    id_type = dict(ids.dtypes)["id"]
    coded = tmp.write(classes.mapInArrow(hash_rows, f"id {id_type}, n bigint, v array<double>, codes array<bigint>"), "coded")
    keyed = coded.select("id", F.posexplode("codes").alias("t", "key"))
    shared = keyed.groupBy("key", "t").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = keyed.join(shared, ["key", "t"]).join(coded, "id")
    units = chunk_pairs(members, "key", "id", "size", chunk)

    def compare(unit: pa.Table) -> pa.RecordBatch | None:
        x = _unit(_matrix(unit.column("v")))
        uid = unit.column("id").to_numpy()
        add, reach = _links(x, _codes(unit.column("codes")), unit.column("n").to_numpy(), uid, unit.column("_c").to_numpy(),
                            unit.column("t")[0].as_py(), threshold)
        hit = (add > 0) | (reach != uid)
        return pa.RecordBatch.from_arrays([pa.array(uid[hit]), pa.array(add[hit]), pa.array(reach[hit])], ["id", "links", "reach"])

    def _codes(col) -> np.ndarray:
        c = col.combine_chunks()
        return c.flatten().to_numpy().reshape(len(c), -1)

    found = tmp.write(map_units(units, ["key", "t", "_i", "_j"], f"id {id_type}, links bigint, reach {id_type}", compare), "found")
    comp = components(found.select(F.col("id").alias("a"), F.col("reach").alias("b")), tmp)
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = (classes.select("label", "h1", "h2", "id", "n").join(linked, "id", "left").join(comp, "id", "left")
             .select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = ids.where("ok").join(named, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    out = out.union(ids.where("not ok").select("id", F.lit(0).cast("bigint"), "id"))
    result = tmp.write(out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")), "result")
    tmp.drop(ids, classes, coded, found)
    return result
