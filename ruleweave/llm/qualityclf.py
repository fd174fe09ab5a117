"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are computed in the tasks.  A small random
forest, fitted on a bounded sample of labelled rows, gives its root-to-node
paths as conjunctive rules; a lasso logistic regression over rule indicators
and statistics keeps few of them, and the result is compiled into one Spark
column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .scratch import Scratch, released, small_batches
from .textops import U64, mix, text_buffers, text_slices, word_hashes, word_spans

#: Distinct labelled texts that the fits see (about as many).
SAMPLE_ROWS = 20_000

STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper_share", "digit_share", "symbol_share", "bang_share", "punct_share",
    "space_share", "high_share", "distinct_words", "same_as_last", "top_word", "dup_lines", "words_per_line",
)

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 symbol, 5 ! and ?, 6 other punctuation, 7 blank, 8 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 6
_KIND[[ord(c) for c in "#*$%&|<>@^~_=+\\/{}[]`"]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 7
_KIND[128:] = 8


def _segment_max_count(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, largest count of a key) for each text."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(key):
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
        new = np.ones(len(k), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(k)))
        np.add.at(distinct, d[at], 1)
        np.maximum.at(top, d[at], size)
    return distinct, top


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text given as bytes and offsets."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    doc_of_byte = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    kinds = np.bincount(doc_of_byte * 9 + _KIND[data], minlength=n * 9).reshape(n, 9)
    start, end, woff = word_spans(data, off)
    words = np.diff(woff).astype(float)
    doc_of_word = np.repeat(np.arange(n), np.diff(woff))
    wh = word_hashes(data, start, end, lower=True)
    distinct, top = _segment_max_count(doc_of_word, wh, n)
    same = np.zeros(n)
    if len(wh) > 1:
        np.add.at(same, doc_of_word[1:][(wh[1:] == wh[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])], 1)
    # lines with a word: their hash is the sum of their words' hashes with places
    line = np.cumsum(data == 10) + doc_of_byte if len(data) else np.zeros(0, np.int64)
    word_line = line[start] if len(start) else np.zeros(0, np.int64)
    lines, dup = np.zeros(n), np.zeros(n)
    if len(wh):
        first = np.flatnonzero(np.append(True, (word_line[1:] != word_line[:-1]) | (doc_of_word[1:] != doc_of_word[:-1])))
        place = (np.arange(len(wh)) - np.repeat(first, np.diff(np.append(first, len(wh))))).astype(U64)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(mix(wh + place * U64(0x9E3779B97F4A7C15)), first)
        lines = np.bincount(doc_of_word[first], minlength=n).astype(float)
        dup = lines - _segment_max_count(doc_of_word[first], h, n)[0]
    safe, wsafe, lsafe = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), (size - kinds[:, 7]) / wsafe, kinds[:, 1] / letters, kinds[:, 3] / safe, kinds[:, 4] / safe,
        kinds[:, 5] / safe, kinds[:, 6] / safe, kinds[:, 7] / safe, kinds[:, 8] / safe, distinct / wsafe, same / wsafe, top / wsafe,
        dup / lsafe, words / lsafe])


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "_stats") -> DataFrame:
    """Add the struct of statistics of each whole text (null: as empty)."""
    def run(batches):
        for text in batches:
            data, off = text_buffers(text)
            parts = [statistics(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in text_slices(off)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])], list(STATISTICS))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(released(run), "struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">")
    small_batches(docs.sparkSession)
    return docs.withColumn(out, udf(F.col(f"`{text_col}`")))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is greater, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, stats: str) -> Column:
        c = F.lit(True)
        for s, greater, t in self.conditions:
            v = F.col(f"{stats}.{s}")
            c = c & ((v > t) if greater else (v <= t))
        return c.cast("double")


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    linear: tuple[tuple[str, float], ...]
    intercept: float

    def score(self, stats: str = "_stats") -> Column:
        """The probability of label 1, as one Spark expression."""
        z = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights):
            z = z + r.column(stats) * F.lit(w)
        for s, w in self.linear:
            z = z + F.col(f"{stats}.{s}") * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_paths(model) -> list[Rule]:
    """All root-to-node paths (the root left out) of a Spark ML forest, distinct."""
    found: dict[tuple, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            bounds: dict[tuple[str, bool], float] = {}
            for s, greater, t in path:  # of several bounds on a side the tightest holds
                old = bounds.get((s, greater))
                bounds[s, greater] = t if old is None else (max if greater else min)(old, t)
            found[tuple(sorted((s, g, t) for (s, g), t in bounds.items()))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            s, t = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
            walk(node.leftChild(), (*path, (s, False, t)))
            walk(node.rightChild(), (*path, (s, True, t)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return [Rule(k) for k in found]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
        trees: int = 12, depth: int = 3, penalty: float = 0.001, seed: int = 2) -> RuleEnsemble:
    """Fit on rows with a 0/1 label (null labels are left out).  Equal
    (text, label) rows count once; of them, about ``sample_rows`` are taken by a
    hash of the text.  Learned from no row, every score is 0.5; from one label,
    every score is near that label."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    n = rows.agg(F.count_distinct(own, "label")).first()[0]
    if not n:
        return RuleEnsemble((), (), (), 0.0)
    place = F.pmod(F.xxhash64(F.lit(seed), own), F.lit(1 << 30)) / F.lit(float(1 << 30))
    tmp = Scratch(spark, "quality")
    return _fit_texts(rows.where(place < min(1.0, sample_rows / n)).distinct().withColumn("weight", F.lit(1.0)), tmp, trees, depth, penalty, seed)


def fit_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                  sample_rows: int = SAMPLE_ROWS, trees: int = 12, depth: int = 3, penalty: float = 0.001, seed: int = 2) -> RuleEnsemble:
    """As ``fit``, from documents and a table of labels by id: about
    ``sample_rows`` / 2 distinct texts of each label, weighted by the number they
    stand for, so that a rare label is learned too.  No text is joined or
    shuffled but those of the sample."""
    tmp = Scratch(docs.sparkSession, "quality")
    texts = labelled_sample(docs, labels, label_col, sample_rows // 2, tmp, seed, id_col, text_col)
    model = _fit_texts(texts, tmp, trees, depth, penalty, seed)
    tmp.drop(texts)
    return model


def _fit_texts(texts: DataFrame, tmp: Scratch, trees: int, depth: int, penalty: float, seed: int) -> RuleEnsemble:
    """The ensemble of a bounded table (text, label, weight)."""
    sample = tmp.write(with_statistics(texts).select("label", "weight", "_stats"), "sample")
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        tmp.drop(sample)
        return RuleEnsemble((), (), (), 0.0)
    if len(counts) < 2:  # one label only: a constant score
        tmp.drop(sample)
        return RuleEnsemble((), (), (), 4.0 if counts.get(1.0) else -4.0)
    vector = lambda cols: array_to_vector(F.array(*cols))
    stats = [F.col(f"_stats.{s}") for s in STATISTICS]
    table = sample.select("label", "weight", vector(stats).alias("features")).coalesce(8)
    forest = RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, subsamplingRate=0.7, minInstancesPerNode=5).fit(table)
    rules = tree_paths(forest)
    table = sample.select("label", "weight", vector([*(r.column("_stats") for r in rules), *stats]).alias("features")).coalesce(8)
    lasso = LogisticRegression(weightCol="weight", elasticNetParam=1.0, regParam=penalty, maxIter=40, tol=1e-5).fit(table)
    w = lasso.coefficients.toArray()
    kept = [(r, float(x)) for r, x in zip(rules, w) if x != 0]
    linear = [(s, float(x)) for s, x in zip(STATISTICS, w[len(rules):]) if x != 0]
    tmp.drop(sample)
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(x for _, x in kept), tuple(linear), float(lasso.intercept))


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1, label 1 likelier when higher) and predicted (1 from
    0.5 on) to every row.

    Null texts count as empty ones, which get the score of their (zero)
    statistics.  Rows are judged one by one on their whole text; an empty table
    gives an empty one; columns named like a result are replaced, others stay
    whatever their names.
    No shuffle.
    """
    keep = [c for c in docs.columns if c not in {"score", "predicted"}]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = with_statistics(held).select("row", model.score().alias("s"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("s").alias("score"), (F.col("s") >= 0.5).cast("int").alias("predicted"))
