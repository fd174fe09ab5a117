"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word 5-grams, as 64-bit hashes.  Two sets
of sizes s and t with Jaccard similarity >= 0.8 differ in at most
D = floor((s + t) / 9) elements.

*Parity sketch.*  Hash an element to a bit and flip it: the Hamming distance of
two such bit sketches is at most the size of the symmetric difference.  Two
forms are used.  A dense one of ``SKETCH_BITS`` bits is the cheap test before
verification.  A wide sparse one (every element flips a bit pattern given by
its 64-bit hash) is cut into B blocks; each block is kept as the XOR of its
elements' hashes, and at most D blocks of two linked documents differ.

*Pigeonhole join.*  Sizes fall into bands with a common number of blocks (a
document just below a band also enters that band, where its larger partners
are).  Two documents agree in B - D blocks or more, so, with blocks in one
fixed order, they share one of the first D + 1 of each.  Blocks with rare
elements stand first in the order; which elements are frequent is found on a
bounded sample and affects the number of candidates only, never the result.

*Verify.*  Documents that share a block are compared exactly where this can
still join two components: first each document with the partner it shares most
blocks with, then, in groups that are not one component yet, all pairs across
components that pass the size and Hamming tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import chunk_pairs, map_units
from .scratch import Scratch, released, small_batches
from .textops import U64, bounds, mix, shingle_sets, text_buffers, text_slices, word_hashes, word_spans

K = 5
SKETCH_BITS = 1024
#: Documents in the sample that orders the blocks; a 5-gram is frequent if it
#: is in so many of them; at most so many frequent 5-grams are broadcast.
ORDER_SAMPLE, FREQUENT_IN, FREQUENT_MAX = 8192, 6, 200_000
CHUNK = 1024


def document_sets(text) -> "list[tuple[int, int, np.ndarray, np.ndarray]]":
    """(first row, rows, row index, hash) of each slice of an Arrow column."""
    data, off = text_buffers(text)
    for i, j in text_slices(off):
        part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        start, end, woff = word_spans(part, o)
        doc, h = shingle_sets(word_hashes(part, start, end, lower=True), woff, K)
        yield i, j - i, doc, h


def band(n: np.ndarray) -> np.ndarray:
    """Band of a size: [1, 4), [4, 16), [16, 64), ..."""
    return (np.floor(np.log2(np.maximum(n, 1))) // 2).astype(np.int64)


def block_keys(doc: np.ndarray, h: np.ndarray, n: np.ndarray, frequent: np.ndarray, scheme: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the first D + 1 blocks of every row, in scheme ``scheme``
    (a row with a scheme below 0 is left out)."""
    use = (scheme >= 0) & (n > 0)
    top = np.int64(4) ** (np.maximum(scheme, 0) + 1)  # sizes of the band end before it
    blocks = np.where(use, top // 4 + 8, 0)
    most = np.where(use, (n + np.minimum(n + n // 4, top - 1)) // 9, -1)  # D for the largest partner
    at = np.cumsum(blocks) - blocks
    token = use[doc]
    d, v = doc[token], h[token]
    total = int(blocks.sum())
    word, count, rare = np.zeros(total, U64), np.zeros(total, np.int64), np.zeros(total, bool)
    if len(v):
        block = at[d] + ((v >> U64(32)) * blocks[d].astype(U64) >> U64(32)).astype(np.int64)  # rises with v
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        b = block[first]
        word[b] = np.bitwise_xor.reduceat(v, first)
        count[b] = np.diff(np.append(first, len(v)))
        if len(frequent):
            common = frequent[np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)] == v
            rare[b] = np.logical_or.reduceat(~common, first)
        else:
            rare[b] = True
    row = np.repeat(np.arange(len(n)), blocks)
    index = np.arange(total) - at[row]
    key = mix(word ^ mix((scheme[row].astype(U64) << U64(40)) + index.astype(U64) + U64(1)))
    # fixed order: blocks with a rare element, then with more elements, then by key
    order = ((~rare).astype(U64) << U64(63)) | ((U64(255) - np.minimum(count, 255).astype(U64)) << U64(55)) | (key >> U64(9))
    by = np.lexsort((order, row))
    place = np.arange(total) - at[row]  # rows stay together in ``by``
    keep = by[place <= most[row]]
    return row[keep], key[keep].view(np.int64)


def bit_sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Dense parity sketches, one row of bytes per document."""
    bit = (mix(h) >> U64(64 - 10)).astype(np.int64)
    flips = np.bincount(doc * SKETCH_BITS + bit, minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(flips.reshape(n, SKETCH_BITS), axis=1)


assert SKETCH_BITS == 1 << 10


def signatures(docs: DataFrame, frequent) -> DataFrame:
    """(id, n, d1, d2, sketch, keys) of every (id, text); d1, d2: digest of the set."""
    id_type = dict(docs.dtypes)["id"]

    def sign(batches):
        common = frequent.value
        for batch in batches:
            for i, rows, doc, h in document_sets(batch.column("text")):
                off = bounds(doc, rows)
                n = np.diff(off)
                k = band(n)
                row, key = block_keys(doc, h, n, common, k)
                up = np.where(5 * n >= 4 * (np.int64(4) ** (k + 1)), k + 1, -1)  # also in the next band
                row2, key2 = block_keys(doc, h, n, common, up)
                row, key = np.concatenate([row, row2]), np.concatenate([key, key2])
                by = np.argsort(row, kind="stable")
                row, key = row[by], key[by]
                with np.errstate(over="ignore"):
                    d1 = np.bincount(doc, minlength=rows).astype(U64) * U64(0)
                    d2 = d1.copy()
                    full = np.flatnonzero(n)
                    if len(full):
                        d1[full] = np.add.reduceat(mix(h ^ U64(0xA5A5)), off[full])
                        d2[full] = np.bitwise_xor.reduceat(mix(h + U64(77)), off[full])
                sk = bit_sketches(doc, h, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, rows), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                     pa.array([r.tobytes() for r in sk], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds(row, rows), pa.int32()), pa.array(key))],
                    ["id", "n", "d1", "d2", "sketch", "keys"])

    return docs.mapInArrow(released(sign), f"id {id_type}, n bigint, d1 bigint, d2 bigint, sketch binary, keys array<bigint>")


def frequent_elements(docs: DataFrame, rows: int) -> np.ndarray:
    """Sorted hashes of 5-grams found often in a bounded sample of documents."""
    share = min(1.0, ORDER_SAMPLE / max(rows, 1))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def elements(batches):
        for batch in batches:
            for _, _, _, h in document_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    found = sample.select("text").mapInArrow(released(elements), "h bigint").groupBy("h").count().where(F.col("count") >= FREQUENT_IN)
    top = found.orderBy(F.desc("count"), "h").limit(FREQUENT_MAX).select("h").toPandas()["h"]
    return np.sort(top.to_numpy(dtype=np.int64).view(U64))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity."""
    id_type = dict(pairs.dtypes)["a"]

    def verify(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            m = batch.num_rows
            sizes = [pa.compute.list_value_length(c).to_numpy(zero_copy_only=False) for c in (x, y)]
            v = np.concatenate([c.flatten().to_numpy() for c in (x, y)])
            row = np.concatenate([np.repeat(np.arange(m), s) for s in sizes])
            by = np.lexsort((v, row))
            v, row = v[by], row[by]
            both = np.bincount(row[1:][(v[1:] == v[:-1]) & (row[1:] == row[:-1])], minlength=m)
            ok = pa.array(100 * both >= percent * (sizes[0] + sizes[1] - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(released(verify), f"a {id_type}, b {id_type}")


def _candidates_across(unit: pa.Table) -> pa.RecordBatch | None:
    """Pairs of a unit across components that pass the size and Hamming tests."""
    comp, n = unit.column("comp").to_numpy(), unit.column("n").to_numpy()
    if comp.min() == comp.max():
        return None
    ids, chunk = unit.column("id").to_numpy(), unit.column("_c").to_numpy()
    sk = np.frombuffer(b"".join(unit.column("sketch").to_pylist()), dtype=U64).reshape(len(ids), -1)
    a, b = [], []
    across = chunk.min() != chunk.max()
    step = max(1, (1 << 20) // len(ids))
    for i in range(0, len(ids), step):
        j = slice(i, i + step)
        ok = (ids[j, None] < ids[None, :]) & (comp[j, None] != comp[None, :])
        if across:
            ok &= chunk[j, None] != chunk[None, :]
        ok &= 5 * np.minimum(n[j, None], n[None, :]) >= 4 * np.maximum(n[j, None], n[None, :])
        p, q = np.nonzero(ok)
        p += i
        apart = np.bitwise_count(sk[p] ^ sk[q]).sum(axis=1)
        near = 9 * apart.astype(np.int64) <= n[p] + n[q]
        a.append(ids[p[near]])
        b.append(ids[q[near]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id), one row per distinct id of ``docs``.

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of
    distinct 5-word shingles (A-Z lower-cased; with fewer words the whole
    sequence is the one shingle); component_id is the smallest id reachable by
    links.  Null texts and texts without words have an empty set and link with
    nothing.  Ids are integers or strings, must not be null and must be unique (of rows with one id the
    one with the larger set counts).  ``percent`` is fixed to 80 or more by the
    bands.  An empty table gives an empty result; other columns are ignored.

    Equal sets are folded into one class (named by its smallest id) before the
    join, and classes are joined back by id at the end.  Links inside a
    component already found are not looked for, so a group of copies costs as
    many comparisons as it has members, not pairs.  No group is gathered:
    candidate groups over ``CHUNK`` are compared as pairs of chunks.
    """
    if percent < 80:
        raise ValueError("similarity must be 80 percent or more")
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "ngramjoin")
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_elements(text, docs.count()))
    signed = tmp.write(signatures(text, frequent), "signed")
    # classes of equal sets
    digest = ["n", "d1", "d2"]
    classes = signed.where("n > 0").groupBy(*digest).agg(F.min("id").alias("rep"))
    members = tmp.write(signed.where("n > 0").select("id", *digest).join(classes, digest).select("id", "rep", "n"), "members")
    reps = members.where("id = rep").select("id").distinct()
    keyed = tmp.write(signed.join(reps, "id", "left_semi").select("id", "n", "sketch", "keys"), "keyed")
    none = tmp.write(signed.where("n = 0").select("id"), "none")
    tmp.drop(signed)
    # documents that share a block
    blocks = keyed.select("id", F.explode("keys").alias("key"))
    groups = blocks.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = tmp.write(blocks.join(groups, "key"), "shared")
    needed = shared.select("id").distinct()
    sets = tmp.write(_sets(text.join(needed, "id", "left_semi")), "sets")
    # each document with the hub it shares most blocks with
    hubs = shared.where("id <> hub").groupBy("hub", "id").agg(F.count(F.lit(1)).alias("c"))
    first = tmp.write(hubs.groupBy("id").agg(F.min_by("hub", F.struct(-F.col("c"), "hub")).alias("a")).select("a", F.col("id").alias("b")), "first")
    links = tmp.write(_similar(first, sets, percent), "links1")
    comp = components(links, tmp)
    # groups that are not one component: all pairs across
    tagged = shared.join(comp, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("comp"))
    tagged = tmp.write(tagged, "tagged")
    open_keys = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_rows = tagged.join(open_keys, "key").join(keyed.select("id", "n", "sketch"), "id")
    units = chunk_pairs(open_rows, "key", "id", "size", CHUNK)
    id_type = dict(text.dtypes)["id"]
    pairs = map_units(units, ["key", "_i", "_j"], f"a {id_type}, b {id_type}", _candidates_across).distinct()
    second = tmp.write(pairs.join(first, ["a", "b"], "left_anti"), "second")
    links2 = tmp.write(links.union(_similar(second, sets, percent)), "links2")
    comp = components(links2, tmp)
    out = members.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    out = out.union(none.select("id", F.lit(0).cast("bigint"), "id"))
    result = tmp.write(out.withColumnRenamed("id", id_col), "result")
    tmp.drop(members, keyed, none, shared, sets, first, links, tagged, second, links2)
    return result


def _sets(docs: DataFrame) -> DataFrame:
    """(id, hashes) of every (id, text)."""
    def run(batches):
        for batch in batches:
            for i, rows, doc, h in document_sets(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, rows), pa.ListArray.from_arrays(pa.array(bounds(doc, rows), pa.int32()), pa.array(h.view(np.int64)))],
                    ["id", "hashes"])

    return docs.mapInArrow(released(run), f"id {dict(docs.dtypes)['id']}, hashes array<bigint>")
