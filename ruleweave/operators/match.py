"""Matching many rules to many cases.

The match is a theta join (rule true for case).  With a rule list held on the
driver it needs no join at all: each rule becomes a ``CASE WHEN`` inside one
projection, and the ids of the rules a case satisfies are exploded to rows.
The projection runs in whole-stage codegen next to the Parquet scan; nothing
is shuffled.  Codegen size grows with the rule count, so the rules are cut
into chunks of ``chunk_size``, one projection each over the needed columns, and
the projections are united – the same lazy plan for any number of rules, on
batch and streaming inputs alike.  With many chunks the input is read once per
chunk; write a costly input first.  Each chunk is rendered as one Spark SQL
expression and parsed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule

ALL_CASES = "*"


def _needed_features(rules: Sequence[Rule]) -> list[str]:
    feats: list[str] = []
    for r in rules:
        for f in r.features:
            if f not in feats:
                feats.append(f)
    return feats


def _str_lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hit_ids(rules: Sequence[Rule]) -> Column:
    """array<string> of the ids of the rules a row satisfies (no NULLs).
    Built as one SQL expression per chunk (one parse, no per-rule
    driver↔JVM calls)."""
    if not rules:
        return F.array().cast("array<string>")
    cases = ", ".join(f"CASE WHEN {r.to_spark_sql()} THEN {_str_lit(r.rule_id)} END"
                      for r in rules)
    return F.expr(f"array_compact(array({cases}))")


def _chunks(seq: Sequence[Rule], n: int):
    for i in range(0, len(seq), n):
        yield seq[i:i + n]


def match_rules(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("case_id",),
                chunk_size: int = 100, with_all_row: bool = False) -> DataFrame:
    """Long hit table: the ``keep`` columns plus ``rule_id``, one row per
    (case, satisfied rule).

    ``with_all_row=True`` adds one extra row per case with ``rule_id = '*'``
    so that a later ``groupBy(rule_id, …)`` yields per-rule and whole-table
    counts in one aggregation pass (no second scan for the totals).
    """
    keep = list(keep)
    rules = list(rules)
    base = df.select(*dict.fromkeys(keep + _needed_features(rules)))
    parts = []
    for i, chunk in enumerate(list(_chunks(rules, chunk_size)) or [[]]):
        ids = hit_ids(chunk)
        if with_all_row and i == 0:
            ids = F.concat(ids, F.array(F.lit(ALL_CASES)))
        parts.append(base.select(*keep, F.explode(ids).alias("rule_id")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_score(rules: Sequence[Rule], coefficients: dict[str, float],
               intercept: float = 0.0, chunk_size: int = 100) -> Column:
    """R8 without explode: intercept + Σ coefficient × [rule matches], built
    as a sum of per-chunk sums inside one projection."""
    terms = []
    rules = [r for r in rules if coefficients.get(r.rule_id, 0.0) != 0.0]
    for chunk in _chunks(rules, chunk_size):
        body = " + ".join(f"(CASE WHEN {r.to_spark_sql()} THEN {float(coefficients[r.rule_id])!r}D"
                          f" ELSE 0.0D END)" for r in chunk)
        terms.append(F.expr(f"({body})"))
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))
