"""Substring dedup with suffix automata of reference shards.

A window of 13 words is removed where the same words also start in a document
with a smaller id.  Here the reference is the corpus itself, so its automata
cannot be broadcast to every task (they would grow with the data); instead both
the reference passages and the passages streamed against them are routed to the
shard where they can meet:

1. Every window is marked by its minimiser, the least hash of its 5-word grams.
   Equal windows have equal minimisers, and neighbouring windows mostly share
   theirs: a *segment* is a run of windows with one minimiser in place (at most
   9 windows, 21 words).  Minimisers found in one document only are dropped.
2. The segments left are folded into distinct word strings, each with the
   smallest id it occurs in, and dealt to shards of bounded size by minimiser
   (a minimiser with more strings than half a shard is dealt by whole windows).
3. In a shard, strings come in the order of that id.  Each is streamed through
   the suffix automaton of the strings before it: where the matching statistic
   reaches 13, the state of the last 13 words knows the smallest id they occur
   in.  A string that brings a new window then extends the automaton.
4. Every occurrence of a string in a later document is a repeat as a whole; in
   its first document the windows found in step 3 are.  Marked windows go back
   to their documents, and the maximal spans that they cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import set_aside
from .scratch import Scratch, released, small_batches
from .textops import U64, text_buffers, text_slices, window_hashes, word_hashes, word_spans

WINDOW, GRAM = 13, 5
#: Strings per shard (an automaton of about 150,000 words).
SHARD = 8192


class SuffixAutomaton:
    """Of several word strings, added in the order of their ids; every state
    keeps the id of the first string that its words occur in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list = [None]

    def _extend(self, last: int, c, doc) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(doc)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def add(self, words: list, doc) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c, doc)

    def match(self, words: list, doc, window: int) -> tuple[int, int]:
        """(bits of the windows that occur in a string of a smaller id, number
        of windows that occur at all)."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = run = bits = known = 0
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                run += 1
            if run >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                known += 1
                if first[s] < doc:
                    bits |= 1 << (i - window + 1)
        return bits, known


def segments(wh: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, first window, windows, minimiser) of all segments;
    windows are numbered by their first word in the document."""
    counts = np.diff(woff)
    nwin = np.maximum(counts - WINDOW + 1, 0)
    total = int(nwin.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64)
    gram = window_hashes(wh, GRAM)
    doc = np.repeat(np.arange(len(counts)), nwin)
    local = np.arange(total) - np.repeat(np.cumsum(nwin) - nwin, nwin)
    start = woff[doc] + local
    low, at = gram[start], start.copy()
    for j in range(1, WINDOW - GRAM + 1):
        g = gram[start + j]
        less = g < low
        low = np.where(less, g, low)
        at[less] = start[less] + j
    new = np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    return doc[first], local[first], np.diff(np.append(first, total)), low[first]


def _segments_of(text: pa.Array) -> Iterator[tuple]:
    """(first row, rows, words of the slice, their offsets, *segments) of each slice."""
    data, off = text_buffers(text)
    for i, j in text_slices(off):
        part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        start, end, woff = word_spans(part, o)
        wh = word_hashes(part, start, end, lower=False)
        yield i, j - i, (part, start, end), woff, segments(wh, woff)


def _minimisers(docs: DataFrame) -> DataFrame:
    """(m, id): distinct minimisers of every (id, text)."""
    def run(batches):
        for batch in batches:
            for i, rows, _, _, (doc, _, _, m) in _segments_of(batch.column("text")):
                by = np.lexsort((m, doc))
                doc, m = doc[by], m[by]
                keep = np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])) if len(m) else np.zeros(0, bool)
                doc, m = doc[keep], m[keep]
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), batch.column("id").slice(i, rows).take(pa.array(doc))], ["m", "id"])

    return docs.mapInArrow(released(run), f"m bigint, id {dict(docs.dtypes)['id']}")


def _shared_segments(docs: DataFrame) -> DataFrame:
    """(m, seg, id, h, start, windows) of the segments of every (id, h, text,
    ms) whose minimiser is in ms; seg: the words joined by a blank."""
    def run(batches):
        for batch in batches:
            ms = batch.column("ms")
            for i, rows, (data, start, end), woff, (doc, win, n, m) in _segments_of(batch.column("text")):
                own = ms.slice(i, rows)
                allowed = own.flatten().to_numpy().view(U64)
                row = np.repeat(np.arange(rows), pa.compute.list_value_length(own).fill_null(0).to_numpy(zero_copy_only=False))
                by = np.lexsort((allowed, row))
                allowed, row = allowed[by], row[by]
                keep = _found(doc, m, row, allowed)
                doc, win, n, m = doc[keep], win[keep], n[keep], m[keep]
                w = woff[doc] + win
                raw = data.tobytes()
                seg = [b" ".join(raw[a:b].split()) for a, b in zip(start[w].tolist(), end[w + n + WINDOW - 2].tolist())]
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(seg, pa.binary()).cast(pa.string()), batch.column("id").take(at), batch.column("h").take(at),
                     pa.array(win, pa.int32()), pa.array(n, pa.int32())], ["m", "seg", "id", "h", "start", "windows"])

    return docs.mapInArrow(released(run), f"m bigint, seg string, id {dict(docs.dtypes)['id']}, h bigint, start int, windows int")


def _found(doc: np.ndarray, m: np.ndarray, row: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which pairs (doc, m) are among the sorted pairs (row, allowed)."""
    if not len(allowed) or not len(m):
        return np.zeros(len(m), bool)
    d = np.concatenate([row, doc])
    v = np.concatenate([allowed, m])
    asked = np.concatenate([np.zeros(len(row), np.int8), np.ones(len(doc), np.int8)])
    by = np.lexsort((asked, v, d))
    d, v, is_asked = d[by], v[by], asked[by]
    group = np.cumsum(np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]))) - 1
    has = np.zeros(group[-1] + 1, bool)
    has[group[is_asked == 0]] = True
    out = np.zeros(len(d), bool)
    out[by] = has[group]
    return out[len(row):]


def _match_shards(strings: DataFrame) -> DataFrame:
    """(m, sh, bits): for every (shard, id, m, sh, off, seg), the windows that
    occur in a smaller id; one automaton per shard, in the order of ids."""
    def run(batches):
        shard, automaton = None, None
        for batch in batches:
            m_out, sh_out, bits_out = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("shard", "id", "m", "sh", "off", "seg")]
            for s, doc, m, sh, off, seg in zip(*cols):
                if s != shard:
                    shard, automaton = s, SuffixAutomaton()
                words = seg.split(" ")
                bits, known = automaton.match(words, doc, WINDOW)
                if known < len(words) - WINDOW + 1:
                    automaton.add(words, doc)
                if bits:
                    m_out.append(m)
                    sh_out.append(sh)
                    bits_out.append(bits << off)
            yield pa.RecordBatch.from_arrays([pa.array(m_out, pa.int64()), pa.array(sh_out, pa.int64()), pa.array(bits_out, pa.int64())], ["m", "sh", "bits"])

    return strings.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(released(run), "m bigint, sh bigint, bits bigint")


def _cut(docs: DataFrame, back: list) -> DataFrame:
    """``back`` of every row, and n_words, n_removed, kept_text; each row has _text, _marks, an
    array of (start, bits), and _copy, true if all of its windows are repeats."""
    def run(batches):
        for text, marks, copy in batches:
            out = []
            for x, mk, cp in zip(text.to_pylist(), marks.to_pylist(), copy.to_pylist()):
                words = x.encode().split() if x else []
                n = len(words)
                if cp and n >= WINDOW:
                    out.append((n, n, ""))
                    continue
                if not mk:
                    out.append((n, 0, b" ".join(words).decode()))
                    continue
                change = np.zeros(n + 1, np.int64)
                for m in mk:
                    s, bits = m["start"], m["bits"]
                    while bits:
                        k = (bits & -bits).bit_length() - 1
                        change[s + k] += 1
                        change[s + k + WINDOW] -= 1
                        bits &= bits - 1
                gone = np.cumsum(change[:-1]) > 0
                out.append((n, int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode()))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                             ["n_words", "n_removed", "kept_text"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(released(run), "struct<n_words:bigint,n_removed:bigint,kept_text:string>")
    cut = docs.withColumn("_cut", udf(F.col("_text"), F.col("_marks"), F.col("_copy")))
    return cut.select(*back, "_cut.n_words", "_cut.n_removed", "_cut.kept_text")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add n_words, n_removed and kept_text (the words left, joined by a blank)
    to every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  A word is removed if a
    window of 13 words that covers it also starts in a row with a smaller id;
    windows are judged on the input.  Null and empty texts have no words; texts
    of fewer than 13 words lose nothing; repeats inside one document, or in
    rows of the same id, stay.  A row with a null id is neither cut nor a
    reference.  An empty table gives an empty result; columns named like a
    result are replaced, others stay.

    Rows with the same text are folded first (all but those of the smallest id
    are repeats as a whole).  Windows are compared word by word in the shards;
    minimisers and strings are told apart by 64-bit hashes (strings by two).
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp = Scratch(spark, "substrdedup")
    columns = [c for c in docs.columns if c not in {"n_words", "n_removed", "kept_text"}]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    ids = tmp.write(base.select("id", "h", F.xxhash64(F.lit(8), "text", F.length("text")).alias("h2")), "ids")
    firsts = ids.groupBy("h", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = tmp.write(ids.join(firsts.where("n > 1"), ["h", "h2"]).where("id > first").select("id", "h").distinct(), "copies")
    originals = base.join(copies, ["id", "h"], "left_anti") if copies.take(1) else base
    originals = originals.where(F.col("id").isNotNull())
    # minimisers in two documents or more
    mins = tmp.write(_minimisers(originals.select("id", "text")), "mins")
    shared = mins.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("m")
    lists = tmp.write(mins.join(shared, "m").groupBy("id").agg(F.collect_list("m").alias("ms")), "lists")  # bounded by the document
    tmp.drop(mins)
    segs = tmp.write(_shared_segments(originals.join(lists, "id")).withColumn("sh", F.xxhash64("seg")), "segs")
    # distinct strings, and their shards
    strings = tmp.write(segs.groupBy("m", "sh", "seg").agg(F.min("id").alias("id")), "strings")
    several = strings.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    varied = tmp.write(strings.join(several, "m"), "varied")
    shards = F.lit(int(varied.count() // SHARD + 1))
    plain = varied.where(F.col("k") <= SHARD // 2).select("m", "sh", "id", "seg", F.lit(0).alias("off"), F.pmod(F.xxhash64("m"), shards).alias("shard"))
    words = F.split("seg", " ")
    many = varied.where(F.col("k") > SHARD // 2).select(
        "m", "sh", "id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))).alias("off", "seg"))
    many = many.select("m", "sh", "id", "seg", "off", F.pmod(F.xxhash64("seg"), shards).alias("shard"))
    hits = _match_shards(plain.unionByName(many)).groupBy("m", "sh").agg(F.bit_or("bits").alias("bits"))
    judged = tmp.write(strings.select("m", "sh", F.col("id").alias("first")).join(hits, ["m", "sh"], "left"), "judged")
    everything = F.expr("shiftleft(1L, windows) - 1L")
    marks = segs.select("m", "sh", "id", "h", "start", "windows").join(judged, ["m", "sh"]).select(
        "id", "h", "start", F.when(F.col("id") > F.col("first"), everything).otherwise(F.coalesce("bits", F.lit(0))).alias("bits"))
    marks = marks.where("bits <> 0").groupBy("id", "h").agg(F.collect_set(F.struct("start", "bits")).alias("_marks"))  # bounded by the document
    marks = marks.union(copies.select("id", "h", F.lit(None).cast("array<struct<start:int,bits:bigint>>"))).withColumn("_copy", F.col("_marks").isNull())
    marks = tmp.write(marks, "marks")
    # the text travels once: as a column of the row, if it stays
    aside, back = set_aside(columns)
    held = F.col(f"c{columns.index(text_col)}") if text_col in columns else F.col("_gone")
    gone = [] if text_col in columns else [F.col(f"`{text_col}`").alias("_gone")]
    rows = docs.select(*aside, *gone, F.col(f"`{id_col}`").alias("_i"), F.xxhash64(text).alias("_h"))
    joined = rows.join(marks.withColumnsRenamed({"id": "_mi", "h": "_mh"}), (F.col("_i") == F.col("_mi")) & (F.col("_h") == F.col("_mh")), "left")
    joined = joined.withColumns({"_copy": F.coalesce("_copy", F.lit(False)), "_text": held})
    tmp.drop(ids, copies, lists, segs, strings, varied, judged)
    return _cut(joined, back)
