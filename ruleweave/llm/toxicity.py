"""Toxicity: a linear-chain conditional random field over the words of a text.

Words are tagged toxic or not.  Labelled tokens come from labelled documents: the
words that, beyond chance, stand in toxic documents are toxic there, everything
else is not.  The field is fitted on a bounded sample; its gradient is summed in
the tasks.  Forward-backward marginals of every whole text give the toxic spans
with their offsets, and the document's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .scratch import Scratch, give_back, small_batches
from .textops import NOT_TERM, U64, bounds, shingle_sets, text_buffers, text_slices, word_hashes, word_spans

#: Distinct labelled texts of each label that the fit sees, about.
SAMPLE_PER_LABEL = 4000
#: Words with a number of their own at most; others share BUCKETS numbers by hash.
OWN_WORDS, BUCKETS = 4096, 1 << 13
#: Steps of the fit, and its penalty on squared weights.
STEPS, PENALTY = 25, 0.5
#: Independent texts that a toxic word needs at least.
LEAST_TEXTS = 4
_BLOCK = 64
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


# ---------------------------------------------------------------------------
# Chains
# ---------------------------------------------------------------------------

def _prefix(m: np.ndarray) -> np.ndarray:
    """First rows' directions of the products m[0] ... m[t] of 2 x 2 matrices, for
    every t: a row (sum 1) proportional to (1, 1) m[0] ... m[t].  Blocks of
    _BLOCK matrices advance together; what enters a block is found the same way
    from the blocks' products."""
    n = len(m)
    if n <= _BLOCK:
        out, a = np.empty((n, 2)), np.array([0.5, 0.5])
        for t in range(n):
            a = a @ m[t]
            a = a / a.sum()
            out[t] = a
        return out
    blocks = -(-n // _BLOCK)
    pad = np.broadcast_to(np.eye(2), (blocks * _BLOCK - n, 2, 2))
    m = np.concatenate([m, pad]).reshape(blocks, _BLOCK, 2, 2)
    steps = np.empty((_BLOCK, 2, 2, blocks))
    p00, p01, p10, p11 = (np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks))
    for t in range(_BLOCK):
        a, b, c, d = m[:, t, 0, 0], m[:, t, 0, 1], m[:, t, 1, 0], m[:, t, 1, 1]
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        size = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * size, p01 * size, p10 * size, p11 * size
        steps[t, 0, 0], steps[t, 0, 1], steps[t, 1, 0], steps[t, 1, 1] = p00, p01, p10, p11
    enter = np.full((blocks, 2), 0.5)
    if blocks > 1:
        enter[1:] = _prefix(np.ascontiguousarray(steps[-1].transpose(2, 0, 1)[:-1]))
    out = enter[:, 0] * steps[:, 0] + enter[:, 1] * steps[:, 1]  # (step, column, block)
    out /= out.sum(axis=1, keepdims=True)
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of chains laid end to end (``first``: where each begins): P(tag 1) of every
    token, P(tags of neighbours) as 2 x 2 (of a chain's first token: the tags
    from anywhere, to be ignored), and the sum of the chains' log partition functions.

    ``emit``: score of tag 1 of each token (tag 0 has 0); ``trans[i, j]``: score
    of tag j after i; ``start``: score of tag 1 at a chain's begin.  A chain's
    first matrix has equal rows, so nothing passes from one chain to the next.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2)), 0.0
    score = np.empty((n, 2, 2))
    score[:, :, 0] = trans[:, 0]
    score[:, :, 1] = trans[:, 1] + emit[:, None]
    score[first, :, 0] = 0.0
    score[first, :, 1] = (start + emit[first])[:, None]
    top = score.max(axis=(1, 2))
    m = np.exp(score - top[:, None, None])
    alpha = _prefix(m)
    # behind token t stand m[t + 1], ...; the last one's product is (1, 1)
    back = np.concatenate([m[1:], np.ones((1, 2, 2))])[::-1].transpose(0, 2, 1)
    beta = _prefix(np.ascontiguousarray(back))[::-1]
    both = alpha * beta
    p1 = both[:, 1] / both.sum(axis=1)
    before = np.concatenate([[[0.5, 0.5]], alpha[:-1]])
    pair = before[:, :, None] * m * beta[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    # log Z is the sum of the steps' growth; rows are equal at a chain's begin
    enter = before.copy()
    enter[first] = (1.0, 0.0)
    grow = (enter[:, :, None] * m).sum(axis=(1, 2))
    return p1, pair, float((np.log(grow) + top).sum())


# ---------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------

KINDS = 4  # other, first letter upper, all upper (two letters at least), with a digit


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text offsets, hash, kind) of the words of texts: runs of
    ASCII letters and digits and of bytes beyond ASCII."""
    start, end, woff = word_spans(data, off, NOT_TERM)
    upper, digit = np.append(0, np.cumsum(_UPPER[data])), np.append(0, np.cumsum(_DIGIT[data]))
    kind = np.zeros(len(start), np.int64)
    if len(start):
        kind[_UPPER[data[start]]] = 1
        kind[(upper[end] - upper[start] == end - start) & (end - start > 1)] = 2
        kind[digit[end] > digit[start]] = 3
    return start, end, woff, word_hashes(data, start, end, lower=True), kind


def _number(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Feature number of words: a place in the sorted hashes ``own``, or a bucket behind them."""
    bucket = OWN_WORDS + (h % U64(BUCKETS)).astype(np.int64)
    if not len(own):
        return bucket
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    return np.where(own[at] == h, at, bucket)


WORDS = OWN_WORDS + BUCKETS
_AT_KIND, _AT_BIAS, _AT_START, _AT_TRANS = 3 * WORDS, 3 * WORDS + KINDS, 3 * WORDS + KINDS + 1, 3 * WORDS + KINDS + 2
SIZE = _AT_TRANS + 4


def _around(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(previous word's weight place, whether there is one, next word's, whether there is one)."""
    n = len(word)
    begins = np.zeros(n + 1, bool)
    begins[first], begins[n] = True, True
    return WORDS + np.roll(word, 1), ~begins[:n], 2 * WORDS + np.roll(word, -1), ~begins[1:]


def emissions(w: np.ndarray, word: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    before, has_before, after, has_after = _around(word, first)
    return w[word] + w[before] * has_before + w[after] * has_after + w[_AT_KIND + kind] + w[_AT_BIAS]


def loss_and_gradient(w: np.ndarray, word: np.ndarray, kind: np.ndarray, tag: np.ndarray, first: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood of the tags and its gradient; ``weight``
    is that of each token's chain."""
    emit = emissions(w, word, kind, first)
    trans = w[_AT_TRANS:].reshape(2, 2)
    inner = np.ones(len(word), bool)
    inner[first] = False
    g = np.zeros(SIZE)
    own, loss = np.flatnonzero(inner), 0.0
    last = np.append(first[1:], len(word))
    for value in np.unique(weight[first]):  # chains of one weight (one per label) at once
        use = np.flatnonzero(weight[first] == value)
        rows = np.concatenate([np.arange(first[i], last[i]) for i in use]) if len(use) < len(first) else np.arange(len(word))
        f = np.cumsum(np.append(0, (last - first)[use]))[:-1]
        p1, pair, log_z = marginals(emit[rows], f, trans, w[_AT_START])
        t = tag[rows]
        told = (emit[rows] * t).sum() + w[_AT_START] * t[f].sum()
        ins = np.ones(len(rows), bool)
        ins[f] = False
        at = np.flatnonzero(ins)
        told += trans[t[at - 1], t[at]].sum()
        loss += value * (log_z - told)
        d = value * (p1 - t)
        rest = (word[rows], kind[rows])
        before, has_before, after, has_after = _around(rest[0], f)
        g += np.bincount(rest[0], d, SIZE) + np.bincount(before, d * has_before, SIZE) + np.bincount(after, d * has_after, SIZE)
        g += np.bincount(_AT_KIND + rest[1], d, SIZE)
        g[_AT_BIAS] += d.sum()
        g[_AT_START] += d[f].sum()
        seen = np.bincount(t[at - 1] * 2 + t[at], minlength=4).reshape(2, 2)
        g[_AT_TRANS:] += (value * (pair[at].sum(axis=0) - seen)).ravel()
    return loss, g


# ---------------------------------------------------------------------------
# The model
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the field, its words with numbers of their own (sorted hashes),
    and the document score's logistic weights over (largest marginal, log of
    1 + number of spans)."""

    weights: np.ndarray | None
    own: np.ndarray
    document: tuple[float, float, float]

    def tag(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(marginal of each word, text offsets in it, byte start and end of words)."""
        start, end, woff, h, kind = tokens(data, off)
        if self.weights is None:
            return np.zeros(len(start)), woff, start, end
        first = woff[:-1][np.diff(woff) > 0]
        emit = emissions(self.weights, _number(h, self.own), kind, first)
        return marginals(emit, first, self.weights[_AT_TRANS:].reshape(2, 2), self.weights[_AT_START])[0], woff, start, end


def spans(p: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word) of the runs of words with marginal >= 0.5."""
    on = p >= 0.5
    begins = np.zeros(len(p) + 1, bool)
    begins[woff] = True
    a = np.flatnonzero(on & (begins[:-1] | ~np.append(False, on[:-1])))
    b = np.flatnonzero(on & (begins[1:] | ~np.append(on[1:], False)))
    return np.searchsorted(woff, a, side="right") - 1, a, b


def _summary(p: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest marginal, number of spans) of each text."""
    n = len(woff) - 1
    top = np.zeros(n)
    np.maximum.at(top, np.repeat(np.arange(n), np.diff(woff)), p)
    return top, np.bincount(spans(p, woff)[0], minlength=n)


def toxic_words(sample: DataFrame) -> list[int]:
    """Hashes of words that stand in toxic texts beyond chance.

    Of texts that share their least 5-word shingle (near copies) one counts.  A
    word's share of toxic texts must be one half at least, and its likelihood
    ratio against the share of all texts beyond chance over all words.  The
    OWN_WORDS most telling ones are kept.
    """
    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column(0))
            label = np.asarray(b.column(1))
            for i, j in text_slices(off):
                _, _, woff, h, _ = tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                doc, sh = shingle_sets(h, woff, 5)
                at = bounds(doc, j - i)
                full = np.flatnonzero(np.diff(at) > 0)
                if not len(full):
                    continue
                group = np.zeros(j - i, U64)
                group[full] = np.minimum.reduceat(sh, at[full])
                own = np.repeat(np.arange(j - i), np.diff(woff))
                by = np.lexsort((h, own))
                own, word = own[by], h[by]
                new = np.append(True, (own[1:] != own[:-1]) | (word[1:] != word[:-1]))
                own, word = own[new], word[new]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(label[i:j][own]), pa.array(group[own].view(np.int64))], ["word", "label", "g"])

    found = sample.select("text", "label").mapInArrow(run, "word bigint, label double, g bigint")
    texts = {r.label: r.n for r in found.groupBy("label").agg(F.count_distinct("g").alias("n")).collect()}
    if len(texts) < 2:
        return []
    words = found.groupBy("word", "label").agg(F.count_distinct("g").alias("n")).groupBy("word").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1.0, F.col("n"))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("label") == 0.0, F.col("n"))), F.lit(0)).alias("b")).where("a > 0")
    base = texts[1.0] / (texts[0.0] + texts[1.0])
    p = F.col("a") / (F.col("a") + F.col("b"))
    ratio = F.col("a") * F.log(p / F.lit(base)) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - p) / F.lit(1 - base))).otherwise(F.lit(0.0))
    chance = math.log(max(1, words.count())) + 3
    kept = words.where((F.col("a") >= LEAST_TEXTS) & (p >= 0.5) & (p > F.lit(base))).withColumn("ratio", ratio).where(F.col("ratio") >= chance)
    return [r.word for r in kept.orderBy(F.desc("ratio"), "word").limit(OWN_WORDS).collect()]


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(word, kind, tag, first, weight of each token) of a batch of coded texts."""
    lists = b.column(0)
    off = np.asarray(lists.offsets)
    x = np.asarray(lists.values)[off[0]:off[-1]].astype(np.int64)
    off = off - off[0]
    first = off[:-1][np.diff(off) > 0]
    return x >> 3, (x >> 1) & 3, x & 1, first, np.repeat(np.asarray(b.column(1)), np.diff(off))


def _minimise(of, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving; every evaluation is one Spark job."""
    f, g = of(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, coef = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            coef.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(coef)):
            q += (a - (y @ q) / (s @ y)) * s
        step, slope = 1.0, -(g @ q)
        if slope > -1e-9 * max(1.0, abs(f)):
            break
        for _ in range(12):
            f2, g2 = of(w - step * q)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g2 - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = f - f2 < 1e-5 * abs(f)
        w, f, g = w - step * q, f2, g2
        if done:
            break
    return w


def _fit_field(sample: DataFrame, own: np.ndarray, tmp: Scratch) -> np.ndarray:
    def code(batches):
        for b in batches:
            data, off = text_buffers(b.column(0))
            label, weight = np.asarray(b.column(1)), np.asarray(b.column(2))
            for i, j in text_slices(off):
                _, _, woff, h, kind = tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                word = _number(h, own)
                tag = (word < OWN_WORDS) & (np.repeat(label[i:j], np.diff(woff)) == 1.0)
                x = (word << 3 | kind << 1 | tag).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(woff, pa.int32()), pa.array(x)), pa.array(weight[i:j])], ["x", "weight"])

    coded = tmp.write(sample.mapInArrow(code, "x array<int>, weight double").where(F.size("x") > 0), "coded")

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches):
            loss, grad = 0.0, np.zeros(SIZE)
            for b in batches:
                if b.num_rows:
                    part = loss_and_gradient(w, *_flat(b))
                    loss, grad = loss + part[0], grad + part[1]
            at = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([grad[at].tobytes()], pa.binary())], ["loss", "at", "g"])

        loss, grad = PENALTY * float(w @ w) / 2, PENALTY * w
        for r in coded.coalesce(8).mapInArrow(run, "loss double, at binary, g binary").collect():  # 8 rows of the model's size
            loss += r.loss
            grad[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.g)
        return loss, grad

    start = np.zeros(SIZE)
    start[_AT_BIAS] = -4.0
    w = _minimise(evaluate, start, STEPS)
    tmp.drop(coded)
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Fit on documents labelled 0 or 1 (1: toxic); the fit sees about
    ``per_label`` distinct texts of each label.  Learned from no row or one label,
    every score is the share of label 1 (0 without a row); without a word that
    tells toxic texts, the field tags nothing."""
    small_batches(docs.sparkSession)
    tmp = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, label_col, per_label, tmp, 12, id_col, text_col)
    counts = {r.label: r.w for r in sample.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    share = counts.get(1.0, 0.0) / max(1e-9, sum(counts.values()))
    logit = math.log((share + 1e-6) / (1 - share + 1e-6))
    own = np.sort(np.array(toxic_words(sample), dtype=np.int64).view(U64)) if len(counts) == 2 else np.zeros(0, U64)
    if not len(own):
        tmp.drop(sample)
        return ToxicityModel(None, own, (logit, 0.0, 0.0))
    field = ToxicityModel(_fit_field(sample, own, tmp), own, (logit, 0.0, 0.0))
    seen = sample.select("label", "weight", _document_udf(field, False)("text").alias("d"))
    table = tmp.write(seen.select("label", "weight", array_to_vector(F.array("d.top", F.log1p("d.n"))).alias("features")), "scored")
    m = LogisticRegression(regParam=1e-4, maxIter=50, weightCol="weight").fit(table.coalesce(8))
    tmp.drop(sample, table)
    return ToxicityModel(field.weights, own, (float(m.intercept), *map(float, m.coefficients.toArray())))


def _document_udf(model: ToxicityModel, with_spans: bool):
    """(largest marginal, number of spans, and the spans where wanted) of texts."""
    kinds = [("top", pa.float64()), ("n", pa.int64())]
    ddl = "top:double,n:bigint"
    if with_spans:
        kinds.append(("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
        ddl += ",spans:array<struct<start:bigint,end:bigint,score:double>>"

    def run(batches):
        for text in batches:
            data, off = text_buffers(text)
            tops, ns, rows = [np.zeros(0)], [np.zeros(0, np.int64)], []
            for i, j in text_slices(off):
                part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                p, woff, start, end = model.tag(part, o)
                top, n = _summary(p, woff)
                tops.append(top)
                ns.append(n)
                if with_spans:
                    chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # code points before each byte
                    own: list[list] = [[] for _ in range(j - i)]
                    for d, a, b in zip(*spans(p, woff)):
                        base = chars[o[d]]
                        own[d].append({"start": int(chars[start[a]] - base), "end": int(chars[end[b]] - base), "score": float(p[a:b + 1].max())})
                    rows.extend(own)
            cols = [pa.array(np.concatenate(tops)), pa.array(np.concatenate(ns).astype(np.int64))]
            if with_spans:
                cols.append(pa.array(rows, kinds[2][1]))
            yield pa.StructArray.from_arrays(cols, [k for k, _ in kinds])
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"struct<{ddl}>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """Add score (0 to 1, label 1 likelier when higher), predicted (1 from 0.5
    on), n_spans and, with ``with_spans``, spans: (start, end, score) of each run
    of toxic words, in characters of the text.

    A null text counts as an empty one, which has no span and the score of a text
    without any.  Rows are judged one by one on their whole text alone; repeated
    rows get equal results; an empty table gives an empty one; columns named like
    a result are replaced, others stay whatever their names.  No shuffle.
    """
    small_batches(docs.sparkSession)
    new = ["score", "predicted", "n_spans", *(["spans"] if with_spans else [])]
    keep = [c for c in docs.columns if c not in new]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _document_udf(model, with_spans)(F.col(f"`{text_col}`")).alias("d"))
    b0, b1, b2 = model.document
    z = F.lit(b0) + F.lit(b1) * F.col("d.top") + F.lit(b2) * F.log1p("d.n")
    held = held.withColumn("s", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    out = [F.col("s").alias("score"), (F.col("s") >= 0.5).cast("int").alias("predicted"), F.col("d.n").alias("n_spans")]
    if with_spans:
        out.append(F.col("d.spans").alias("spans"))
    return held.select(*[F.col("row")[c].alias(c) for c in keep], *out)
