"""Quality rules: a threshold table compiled into one Spark projection.

Everything is made of Spark's own functions: no user functions, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import set_aside

_WS = r"[\x20\x09-\x0D]"
WINDOW = 8

#: Frequent function words (fixed word list) of English, German, French, Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "this", "was", "on", "by", "be", "it", "as",
    "der", "die", "das", "und", "ist", "nicht", "mit", "von", "zu", "den", "ein", "eine",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "dans", "pour",
    "el", "los", "las", "en", "y", "del", "por", "con", "para", "no", "se", "es",
)


@dataclass(frozen=True)
class Threshold:
    """Keep a text while ``low <= statistic <= high`` (null bound: open)."""

    statistic: str
    low: float | None = None
    high: float | None = None


#: The threshold table; a parameter.
THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 14.0),
    Threshold("symbol_ratio", None, 0.10),
    Threshold("stop_word_ratio", 0.02, None),
    Threshold("dup_line_ratio", None, 0.50),
    Threshold("upper_ratio", None, 0.60),
)


def _neighbours_equal(sorted_pairs: Column) -> Column:
    """Positions of the sorted (hash, position) pairs whose hash occurs twice or more."""
    n = F.size(sorted_pairs)
    hit = F.filter(
        F.transform(sorted_pairs, lambda s, i: F.struct(
            s["i"].alias("i"),
            (((i > 0) & (F.get(sorted_pairs, i - 1)["h"] == s["h"]))
             | ((i < n - 1) & (F.get(sorted_pairs, i + 1)["h"] == s["h"]))).alias("twice"))),
        lambda s: s["twice"])
    return F.array_sort(F.transform(hit, lambda s: s["i"]))


def _covered(positions: Column) -> Column:
    """Words covered by the windows that start at these sorted positions."""
    n = F.size(positions)
    steps = F.transform(positions, lambda p, i: F.when(
        i < n - 1, F.least(F.lit(WINDOW), F.get(positions, i + 1) - p)).otherwise(F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def base_counts(text: Column) -> dict[str, Column]:
    """The steps of the projection, by name; each may use those before it."""
    h = F.col("_h")
    pairs, pos = F.col("_pairs"), F.col("_pos")
    return {
        "_t": F.coalesce(text, F.lit("")),
        "_w": F.filter(F.split("_t", _WS + "+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_words": F.size("_w").cast("long"),
        "word_chars": (F.length("_t") - F.regexp_count("_t", F.lit(_WS))).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_upper": F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long"),
        "n_letters": F.regexp_count("_t", F.lit(r"\p{L}")).cast("long"),
        "n_stop_words": F.regexp_count(F.lower("_t"), F.lit(r"(?<![\p{L}])(?:" + "|".join(sorted(STOP_WORDS)) + r")(?![\p{L}])")).cast("long"),
        "_wh": F.transform("_w", lambda w: F.xxhash64(w)),
        # hash of the eight word hashes from i on
        "_h": F.when(F.size("_w") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("_w") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
        "_twice": F.size(F.array_distinct(h)) < F.size(h),
        "_pairs": F.when(F.col("_twice"), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
        "_pos": F.when(F.col("_twice"), _neighbours_equal(pairs)),
        "n_repeat_words": F.when(F.col("_twice"), _covered(pos)).otherwise(F.lit(0).cast("long")),
    }


def statistics() -> dict[str, Column]:
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "upper_ratio": ratio("n_upper", "n_letters"),
    }


def compile_thresholds(table=THRESHOLDS) -> Column:
    """True where every statistic is within its bounds."""
    ok = F.lit(True)
    for t in table:
        if t.low is not None:
            ok = ok & (F.col(t.statistic) >= t.low)
        if t.high is not None:
            ok = ok & (F.col(t.statistic) <= t.high)
    return ok


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Add counts, ratios, ``base_failed`` and ``kept`` to every row.

    A null or empty text has zero counts, so it fails the base rule (fewer
    than 20 words).  ``n_repeat_words`` counts words in 8-word windows that
    occur twice or more in the text, the first occurrence included; windows
    are compared by the 64-bit hash of their words' 64-bit hashes.  Rows are
    judged one by one, so repeated rows get equal verdicts and an empty table
    an empty one; input columns stay, those named like a result are replaced.
    Work per text is linear but for one sort, done only if a window repeats.
    """
    steps, stats = base_counts(F.col("_text")), statistics()
    results = [c for c in [*steps, *stats] if not c.startswith("_")] + ["base_failed", "kept"]
    keep = [c for c in docs.columns if c not in results]
    aside, back = set_aside(keep)
    df = docs.select(*aside, F.col(f"`{text_col}`").alias("_text"))
    for name, col in steps.items():
        df = df.withColumn(name, col)
    df = df.withColumns(stats)
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & compile_thresholds(thresholds))
    return df.select(*back, *results)


SQL_KEPT = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT doc_id, x,
    list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws,
    list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), e AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM e) WHERE c > 1
), v AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(ws) AS n_words,
    length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(regexp_extract_all(x, '\p{{Lu}}')) AS n_upper,
    len(regexp_extract_all(x, '\p{{L}}')) AS n_letters,
    len(list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}]+'), lambda v: list_contains({list(STOP_WORDS)}, v))) AS n_stop_words,
    coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN v USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0
    AND n_symbols / greatest(word_chars, 1) <= 0.10
    AND n_stop_words / greatest(n_words, 1) >= 0.02
    AND n_dup_lines / greatest(n_lines, 1) <= 0.50
    AND n_upper / greatest(n_letters, 1) <= 0.60 AS kept
FROM c
"""
