"""Ranked lexical search by two trees, one over the items and one over documents.

Terms of all documents are counted once, against the terms of the items.  Every
task then takes its documents a batch at a time and builds a tree over them whose
nodes hold, for every term, the greatest impact of a document below; a tree over
the items holds the greatest weights.  The product of two nodes bounds the score
of every pair below them, so a pair of nodes whose bound lies under the weakest
50th score of its items is dropped whole.  Bounds are exact integers, and only
pairs strictly below are dropped: results are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, small_batches
from .textops import NOT_TERM, U64, text_buffers, text_slices, word_hashes, word_spans

#: Documents whose best scores give the first bounds (any number is right).
FIRST_DOCS = 20_000
#: (item, term) pairs of one block of items, about; blocks are searched one by one.
BLOCK_PAIRS = 1 << 16
#: Documents of a leaf, items of a leaf, entries of a tree level's matrix.
DOC_LEAF, ITEM_LEAF, LEVEL = 16, 8, 1 << 22
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every term, A-Z lower-cased; offsets of texts in it)."""
    start, end, woff = word_spans(data, off, NOT_TERM)
    return word_hashes(data, start, end, lower=True), woff


# ---------------------------------------------------------------------------
# Items and documents as term counts
# ---------------------------------------------------------------------------

def _item_terms(items: DataFrame, item_id: str, text_col: str) -> DataFrame:
    """(item, h): distinct terms of each item id, over all its rows."""
    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column(1))
            h, woff = term_hashes(data, off)
            doc = np.repeat(np.arange(b.num_rows), np.diff(woff))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(h.view(np.int64))], ["item", "h"])

    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("h", T.LongType())])
    return items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).distinct()


def _doc_terms(docs: DataFrame, doc_id: str, text_col: str, vocabulary) -> DataFrame:
    """(doc, n, terms, tfs) of each document with a term: its length and its
    counts of the vocabulary's terms, by their numbers."""
    def run(batches):
        v = vocabulary.value
        for b in batches:
            data, off = text_buffers(b.column(1))
            for i, j in text_slices(off):
                h, woff = term_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = np.diff(woff)
                at = np.searchsorted(v, h)
                at[at == len(v)] = 0
                hit = np.flatnonzero(v[at] == h) if len(v) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(j - i), n)
                key, tf = np.unique(doc[hit] * max(len(v), 1) + at[hit], return_counts=True)
                d, t = np.divmod(key, max(len(v), 1))
                own = np.searchsorted(d, np.arange(j - i + 1))
                out = pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(t, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(tf, pa.int64()))], ["doc", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc", kind)] + T.StructType.fromDDL("n bigint, terms array<int>, tfs array<bigint>").fields)
    return docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# The two trees
# ---------------------------------------------------------------------------

def _dense(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Coordinate maxima of the entries by (row, column)."""
    m = np.zeros(shape)
    np.maximum.at(m, (rows, cols), vals)
    return m


class ItemTree:
    """Items in leaves of similar ones: per leaf and per item the weight of each term."""

    def __init__(self, pairs: list[tuple[int, int]], weights: np.ndarray, n_items: int):
        own: list[list[int]] = [[] for _ in range(n_items)]
        for i, t in pairs:
            own[i].append(t)
        # items whose heaviest terms are the same stand together
        order = sorted(range(n_items), key=lambda i: sorted(own[i], key=lambda t: (-weights[t], t))[:3])
        self.order = np.array(order, dtype=np.int64)
        place = np.empty(n_items, np.int64)
        place[self.order] = np.arange(n_items)
        pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.row, self.col = place[pairs[:, 0]], pairs[:, 1]
        self.weights, self.n = weights.astype(np.float64), n_items
        self.leaves = -(-n_items // ITEM_LEAF)

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaf maxima, items), made in the task that searches."""
        w, v = self.weights[self.col], len(self.weights)
        return _dense(self.row // ITEM_LEAF, self.col, w, (self.leaves, v)), _dense(self.row, self.col, w, (self.n, v))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m)."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def search_batch(leaf_w: np.ndarray, item_w: np.ndarray, off: np.ndarray, terms: np.ndarray, impact: np.ndarray,
                 least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item places, documents, scores) of all pairs whose score is above 0 and
    not below the item's bound ``least``.  Documents are ``terms[off[d]:off[d + 1]]``."""
    docs, v = len(off) - 1, leaf_w.shape[1]
    doc = np.repeat(np.arange(docs), np.diff(off))
    heavy = np.full(docs, -1)
    if len(terms):  # documents whose weightiest term is the same stand together
        worth = impact * leaf_w.max(axis=0)[terms]
        by = np.lexsort((worth, doc))
        last = np.append(np.flatnonzero(np.diff(doc[by])), len(by) - 1)
        heavy[doc[by][last]] = terms[by][last]
    order = np.argsort(heavy, kind="stable")
    order = order[heavy[order] >= 0]
    place = np.full(docs, -1)
    place[order] = np.arange(len(order))
    row = place[doc]
    leaves = -(-len(order) // DOC_LEAF)
    root = _dense(np.zeros(len(row), np.int64), terms, impact, (1, v))
    weakest = np.append(least, np.full(-len(least) % ITEM_LEAF, np.inf)).reshape(-1, ITEM_LEAF).min(axis=1)
    live = np.flatnonzero((leaf_w @ root[0] >= weakest) & (leaf_w @ root[0] > 0))  # item leaves against all documents
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(live) or not leaves:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    node = _dense(row // DOC_LEAF, terms, impact, (leaves, v))
    bound = leaf_w[live] @ node.T  # item leaves against document leaves
    meets = (bound >= weakest[live, None]) & (bound > 0)
    by = np.argsort(row, kind="stable")
    row, terms, impact = row[by], terms[by], impact[by]
    cut = np.searchsorted(row, np.arange(leaves + 1) * DOC_LEAF)
    for leaf in np.flatnonzero(meets.any(axis=0)):
        items = (live[meets[:, leaf], None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
        items = items[items < len(least)]
        b = item_w[items] @ node[leaf]  # single items against the document leaf
        items = items[(b >= least[items]) & (b > 0)]
        if not len(items):
            continue
        own = slice(cut[leaf], cut[leaf + 1])
        used, col = np.unique(terms[own], return_inverse=True)
        size = min(DOC_LEAF, len(order) - leaf * DOC_LEAF)
        exact = item_w[np.ix_(items, used)] @ _dense(row[own] - leaf * DOC_LEAF, col, impact[own], (size, len(used))).T
        i, d = np.nonzero((exact >= least[items, None]) & (exact > 0))
        found.append((items[i], order[leaf * DOC_LEAF + d], exact[i, d]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return tuple(map(np.concatenate, zip(*found)))


def _best(item: np.ndarray, score: np.ndarray, docs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the k best of each item, equal scores by rising document; whether
    a row is its item's k-th)."""
    tie = np.empty(len(docs), np.int64)
    tie[np.asarray(pc.sort_indices(docs, null_placement="at_start"))] = np.arange(len(docs))
    by = np.lexsort((tie, -score, item))
    first = np.searchsorted(item[by], item[by])
    rank = np.arange(len(by)) - first
    return by[rank < k], (rank == k - 1)[rank < k]


def _search(counted: DataFrame, tree, n_docs: int, n_terms: int, least, k: int) -> DataFrame:
    """(place, doc, score): the k best documents of each task for every item."""
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("doc", counted.schema["doc"].dataType), T.StructField("score", T.LongType())])

    def run(batches):
        index = tree.value
        leaf_w, item_w = index.matrices()
        low = np.array(least.value, dtype=np.float64)
        rows = max(DOC_LEAF, min(4096, LEVEL // max(leaf_w.shape[1], 1) * DOC_LEAF))
        held = None
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                n = np.asarray(part.column(1))
                lists, counts = part.column(2), part.column(3)
                off = np.asarray(lists.offsets)
                terms = np.asarray(lists.values)[off[0]:off[-1]].astype(np.int64)
                tf = np.asarray(counts.values)[off[0]:off[-1]]
                off = off - off[0]
                m = 50 + (50 * n * n_docs) // n_terms
                item, doc, score = search_batch(leaf_w, item_w, off, terms, impacts(tf, np.repeat(m, np.diff(off))).astype(np.float64), low)
                if not len(item):
                    continue
                new = pa.table({"place": pa.array(item, pa.int32()), "doc": part.column(0).take(pa.array(doc)), "score": pa.array(score.astype(np.int64))})
                held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
                i, s = np.asarray(held["place"]), np.asarray(held["score"])
                keep, kth = _best(i, s, held["doc"].combine_chunks(), k)
                held = held.take(pa.array(keep)).combine_chunks()
                low[i[keep][kth]] = np.maximum(low[i[keep][kth]], s[keep][kth])
        if held is not None:
            yield from held.to_batches(max_chunksize=10_000)

    return counted.mapInArrow(run, schema)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("place").orderBy(F.desc("score"), F.asc("doc"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _blocks(terms: DataFrame) -> int:
    """Number of blocks of items (by hash) that keeps each near BLOCK_PAIRS pairs."""
    count = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = count.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).first()
    blocks = max(1, -(-(total.n or 0) // BLOCK_PAIRS))
    while blocks > 1:
        most = count.groupBy(_block(blocks).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).where(
            (F.col("n") > 2 * BLOCK_PAIRS) & (F.col("items") > 1)).limit(1).count()
        if not most:
            break
        blocks *= 2
    return blocks


def _block(blocks: int):
    return F.pmod(F.xxhash64(F.lit(13), "item"), F.lit(blocks))


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", first_docs: int = FIRST_DOCS) -> DataFrame:
    """(item id, rank, document id, score): the k best documents of each item.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score
    is the sum of weight * ((10**9 tf) div (1000 tf + 20 m)) over the item's
    distinct terms, where m = 50 + (50 n N) div L; scores of 0 are left out and
    equal scores go by rising document id.  Documents and items without a term
    (null or empty texts among them) are in no result.  Repeated document rows
    are ranked each; rows of one item id count as one item with all their terms.
    Ids may be null.  Only ids and texts are read, so other columns may have any
    name.  An empty table of documents or items gives an empty result.

    Items are taken in blocks of about BLOCK_PAIRS (item, term) pairs, whose
    index is broadcast; documents are counted once per block and searched where
    they lie, and only the best of each task are shuffled.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "lexsearch")
    kinds = [T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
             T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]
    pairs = tmp.write(_item_terms(items, item_id, item_text), "items")
    blocks, result = _blocks(pairs), None
    for b in range(blocks):
        out = _search_block(docs, pairs.where(_block(blocks) == b), k, doc_id, doc_text, first_docs, tmp)
        if out is not None:
            out = out.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
            result = out if result is None else result.unionByName(out)
    tmp.drop(pairs)
    return result if result is not None else spark.createDataFrame([], T.StructType(kinds))


def _search_block(docs, pairs, k, doc_id, doc_text, first_docs, tmp) -> DataFrame | None:
    spark = docs.sparkSession
    rows = pairs.collect()  # one block: bounded by BLOCK_PAIRS, or one item
    if not rows:
        return None
    vocabulary = np.unique(np.array([r.h for r in rows], dtype=np.int64).view(U64))
    counted = tmp.write(_doc_terms(docs, doc_id, doc_text, spark.sparkContext.broadcast(vocabulary)), "counted")
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        tmp.drop(counted)
        return None
    df = {r.t: r.n for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))])
    names = list(dict.fromkeys(r.item for r in rows))
    number = {x: i for i, x in enumerate(names)}
    at = np.searchsorted(vocabulary, np.array([r.h for r in rows], dtype=np.int64).view(U64))
    index = ItemTree([(number[r.item], int(t)) for r, t in zip(rows, at) if int(t) in df], weights, len(names))
    tree = spark.sparkContext.broadcast(index)
    low = np.zeros(len(names))

    def search(table: DataFrame) -> DataFrame:
        return _top(_search(table, tree, total.docs, total.terms, spark.sparkContext.broadcast(low), k), k)

    if total.docs > 2 * first_docs:  # the k-th scores over some documents bound those over all
        some = counted.where(F.pmod(F.xxhash64(F.lit(5), "doc", "n"), F.lit(1 << 20)) < int((1 << 20) * first_docs / total.docs))
        for r in search(some).where(F.col("rank") == k).select("place", "score").collect():  # one row per item
            low[r.place] = r.score
    best = search(counted)
    kinds = T.StructType([T.StructField("place", T.IntegerType()), pairs.schema["item"]])
    ids = spark.createDataFrame([(p, names[i]) for p, i in enumerate(index.order.tolist())], kinds)
    out = tmp.write(best.join(F.broadcast(ids), "place").select("item", "rank", "doc", "score"), "found")
    tmp.drop(counted)
    return out


#: The same over the tables documents and benchmark, for DuckDB.
ORACLE = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM documents),
  dt AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
  dn AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY ALL),
  s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM dn),
  w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, s GROUP BY t, nd),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM benchmark),
  m AS (SELECT doc_id, 50 + ((50 * n * nd) // l) AS m FROM dn, s),
  sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
         FROM q JOIN w USING (t) JOIN dt USING (t) JOIN m USING (doc_id) GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
