"""Language ID: language family first, then linear one-versus-one support
vector machines between the languages of the family.

Features are hashed byte n-grams (1 to 3) of the whole text, ASCII letters
lower-cased and everything but letters made a blank; a text's vector has
length one.  All machines are Spark ML ``LinearSVC`` fits on a bounded sample
of labelled rows; texts are scored in the tasks by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, released, small_batches
from .textops import text_buffers, text_slices

DIM = 2048
#: Distinct labelled texts that the fits see, per language (about as many).
SAMPLE_PER_LANGUAGE = 800
#: Bytes of text handled at once (some 50 bytes of arrays for each).
SLICE = 1 << 18
UNDETERMINED = "und"

#: Family of each language code (fixed list); others are families of their own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
    "fi": "uralic", "hu": "uralic", "et": "uralic",
}

_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Length-one rows of n-gram counts (roots of counts, so that repeated
    passages weigh less) of texts given as bytes and offsets."""
    n = len(off) - 1
    b = _CLASS[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off)) * DIM
    total = np.zeros(n * DIM)
    for k in (1, 2, 3):
        m = len(b) - k + 1
        if m <= 0:
            break
        code = np.full(m, k, dtype=np.uint32)
        for j in range(k):
            code = code * np.uint32(0x01000193) ^ b[j:j + m]
        slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64)
        ok = (doc[:m] == doc[k - 1:]) & (b[:m] + b[k - 1:] != 64)  # inside one text, not blank at both ends
        total += np.bincount((doc[:m] + slot)[ok], minlength=n * DIM)
    x = np.sqrt(total.reshape(n, DIM))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


assert DIM == 1 << 11


@dataclass(frozen=True)
class Machine:
    """Positive margin: ``first``, else ``second`` (families or languages)."""

    first: str
    second: str
    weights: np.ndarray
    intercept: float


@dataclass(frozen=True)
class LanguageModel:
    families: dict[str, list[str]]
    between: list[Machine]
    within: list[Machine]

    @staticmethod
    def _vote(names: list[str], machines: list[Machine], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its least probability-like margin against another)."""
        if len(names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        at = {c: i for i, c in enumerate(names)}
        own = [m for m in machines if m.first in at and m.second in at]
        p = 1 / (1 + np.exp(-np.clip(2 * (x @ np.stack([m.weights for m in own], axis=1) + [m.intercept for m in own]), -50, 50)))
        votes, against = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
        for k, m in enumerate(own):
            a, b = at[m.first], at[m.second]
            votes[:, a] += p[:, k] > 0.5
            votes[:, b] += p[:, k] <= 0.5
            against[:, a] = np.minimum(against[:, a], p[:, k])
            against[:, b] = np.minimum(against[:, b], 1 - p[:, k])
        win = (votes + against / 2).argmax(axis=1)
        return win, against[np.arange(len(x)), win]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.families:  # learned from nothing
            return np.full(len(x), UNDETERMINED, dtype=object), np.zeros(len(x))
        names = sorted(self.families)
        fam, score = self._vote(names, self.between, x)
        lang = np.empty(len(x), dtype=object)
        for i, f in enumerate(names):
            rows = np.flatnonzero(fam == i)
            if len(rows):
                win, s = self._vote(self.families[f], self.within, x[rows])
                lang[rows] = np.array(self.families[f], dtype=object)[win]
                score[rows] *= s
        return lang, score


def _feature_udf(of):
    """An Arrow function of whole texts, slice by slice."""
    def run(batches):
        for text in batches:
            data, off = text_buffers(text)
            out = []
            for i, j in text_slices(off, SLICE):
                out.append(of(features(data[off[i]:off[j]], off[i:j + 1] - off[i])))
            yield pa.concat_arrays(out) if out else of(np.zeros((0, DIM)))
    return released(run)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE,
        seed: int = 7, families: dict[str, str] = FAMILIES) -> LanguageModel:
    """Fit on labelled rows (null labels and texts without a letter are left
    out).  Equal (text, label) rows count once; of them, about ``per_language``
    of each language are taken, by a hash of the text.  A model learned from no
    row calls every text ``und``; one learned from one language knows only it."""
    spark = rows.sparkSession
    small_batches(spark)
    label, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    labelled = rows.select(label.alias("lang"), text.alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}  # one row per language
    if not counts:
        return LanguageModel({}, [], [])
    share = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.lit(seed), F.xxhash64("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    to_list = F.arrow_udf(_annotated(_feature_udf(lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float64())))), "array<double>")
    sample = labelled.where(place < share[F.col("lang")]).distinct()  # copies fold in the tasks, before the shuffle
    tmp = Scratch(spark, "langid")
    written = tmp.write(sample.select("lang", to_list("text").alias("x")), "sample")
    table = written.select("lang", array_to_vector("x").alias("features"))
    groups: dict[str, list[str]] = {}
    for c in sorted(counts):
        groups.setdefault(families.get(c, f"={c}"), []).append(c)

    def machine(a: str, b: str, first: list[str], second: list[str]) -> Machine:
        part = table.where(F.col("lang").isin([*first, *second])).select("features", F.col("lang").isin(first).cast("double").alias("label"))
        m = LinearSVC(maxIter=15, regParam=1e-3, standardization=False, tol=1e-3).fit(part.coalesce(8))
        return Machine(a, b, m.coefficients.toArray(), float(m.intercept))

    between = [machine(f, g, groups[f], groups[g]) for f, g in combinations(sorted(groups), 2)]
    within = [machine(a, b, [a], [b]) for f in sorted(groups) for a, b in combinations(groups[f], 2)]
    tmp.drop(written)
    return LanguageModel(groups, between, within)


def _annotated(run):
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) to every row.

    A text that is null or has no letter gets ``und`` and score 0.  Rows are
    judged one by one on their whole text alone; an empty table gives an empty
    one; columns named like a result are replaced, others stay whatever their
    names.  No shuffle.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def judge(x: np.ndarray) -> pa.Array:
        lang, score = model.predict(x)
        return pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(score)], fields=list(kind))

    udf = F.arrow_udf(_annotated(_feature_udf(judge)), "struct<lang:string,score:double>")
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in {"lang_pred", "score"}]
    text = F.col(f"`{text_col}`")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), udf(text).alias("p"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep],
                      F.when(F.col("letter"), F.col("p.lang")).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
                      F.when(F.col("letter"), F.col("p.score")).otherwise(F.lit(0.0)).alias("score"))
