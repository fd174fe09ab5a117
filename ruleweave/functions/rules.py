"""Structured decision rules (P13, A3/A4 rule facts, A4 rule → features).

A rule is a conjunction of conditions on case columns.  It renders to a
Spark ``Column`` (evaluated inside whole-stage codegen) and, for checks, to
SQL text.  A condition on a NULL or NaN value is *not* satisfied, so a rule on a
column with NULLs does not match those cases (dplyr ``filter`` drops NA and NaN).
An empty set matches nothing for ``in`` and every non-NULL value for ``not in``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUM_OPS = {">", ">=", "<", "<=", "==", "!="}
_SET_OPS = {"in", "not in"}


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str
    value: float | str | None = None
    values: tuple = ()
    or_missing: bool = False  # a NULL (or NaN) satisfies the condition too

    def __post_init__(self):
        if self.op not in _NUM_OPS | _SET_OPS:
            raise ValueError(f"unknown operator {self.op!r}")

    def to_column(self) -> Column:
        return F.expr(self.to_spark_sql())

    def to_spark_sql(self) -> str:
        """Spark SQL text (column names back-quoted).  Rendering rules as
        text and parsing once per chunk avoids one driver↔JVM round trip per
        sub-expression, which dominates plan building for thousands of rules."""
        f = "`" + self.feature.replace("`", "``") + "`"
        if self.or_missing:
            known = replace(self, or_missing=False).to_spark_sql()
            nan = f" OR isnan({f})" if self.op in _NUM_OPS and not isinstance(self.value, str) else ""
            return f"({f} IS NULL{nan} OR {known})"
        if self.op in _SET_OPS:
            if not self.values:
                return "false" if self.op == "in" else f"({f} IS NOT NULL)"
            vals = ", ".join(_spark_lit(v) for v in self.values)
            neg = "NOT " if self.op == "not in" else ""
            # NULL feature → not satisfied
            return f"({f} IS NOT NULL AND coalesce({neg}({f} IN ({vals})), false))"
        op = "=" if self.op == "==" else self.op
        if not isinstance(self.value, str):  # Spark holds NaN above every number and equal to itself
            return f"coalesce({f} {op} {_spark_lit(self.value)} AND NOT isnan({f}), false)"
        return f"coalesce({f} {op} {_spark_lit(self.value)}, false)"

    def to_sql(self) -> str:
        f = self.feature
        if self.or_missing:
            nan = f" OR {f} = 'nan'::DOUBLE" if self.op in _NUM_OPS and not isinstance(self.value, str) else ""
            return f"({f} IS NULL{nan} OR {replace(self, or_missing=False).to_sql()})"
        if self.op in _SET_OPS:
            if not self.values:
                return "false" if self.op == "in" else f"({f} IS NOT NULL)"
            vals = ", ".join(_sql_lit(v) for v in self.values)
            neg = "NOT " if self.op == "not in" else ""
            return f"({f} IS NOT NULL AND {f} {neg}IN ({vals}))"
        op = "=" if self.op == "==" else ("<>" if self.op == "!=" else self.op)
        if not isinstance(self.value, str):
            return f"coalesce({f} {op} {_sql_lit(self.value)} AND {f} <> 'nan'::DOUBLE, false)"
        return f"coalesce({f} {op} {_sql_lit(self.value)}, false)"

    def text(self) -> str:
        missing = " or missing" if self.or_missing else ""
        if self.op in _SET_OPS:
            return f"{self.feature} {self.op} ({', '.join(map(str, self.values))}){missing}"
        return f"{self.feature} {self.op} {self.value}{missing}"


def _sql_lit(v) -> str:
    """Literal for standard SQL (the DuckDB twins): '' escapes a quote."""
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _spark_lit(v) -> str:
    """Literal for Spark SQL: backslash escapes; doubles carry the D suffix
    (a bare 0.07 would be parsed as a decimal)."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D" if abs(v) != float("inf") else f"double('{v}')"
    return repr(v)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    conditions: tuple[Condition, ...] = field(default_factory=tuple)

    def to_column(self) -> Column:
        return F.expr(self.to_spark_sql())

    def to_spark_sql(self) -> str:
        if not self.conditions:
            return "true"
        return "(" + " AND ".join(c.to_spark_sql() for c in self.conditions) + ")"

    def to_sql(self) -> str:
        if not self.conditions:
            return "true"
        return " AND ".join(c.to_sql() for c in self.conditions)

    def text(self) -> str:
        return " & ".join(c.text() for c in self.conditions)

    @property
    def features(self) -> list[str]:
        seen: list[str] = []
        for c in self.conditions:
            if c.feature not in seen:
                seen.append(c.feature)
        return seen


def rule(rule_id: str, *conds: tuple) -> Rule:
    """Short constructor: ``rule('R1', ('n_lines', '>', 4), ('segment', 'in', ['A']))``."""
    out = []
    for feat, op, val in conds:
        if op in _SET_OPS:
            out.append(Condition(feat, op, values=tuple(val)))
        else:
            out.append(Condition(feat, op, value=val))
    return Rule(rule_id, tuple(out))


RULE_TABLE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("rule_text", T.StringType(), False),
    T.StructField("n_conditions", T.IntegerType(), False),
    T.StructField("features", T.ArrayType(T.StringType()), False),
    T.StructField("conditions_json", T.StringType(), False),
])


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rule list as a small DataFrame (one row per rule).  Its size is the
    number of rules held on the driver, so it is safe to broadcast."""
    rows = [(r.rule_id, r.text(), len(r.conditions), r.features,
             json.dumps([c.__dict__ | {"values": list(c.values)} for c in r.conditions]))
            for r in rules]
    return spark.createDataFrame(rows, RULE_TABLE_SCHEMA)


def canonical_text(conditions: Sequence[Condition]) -> str:
    """Text of a conjunction that does not depend on the order of its conditions."""
    return " & ".join(c.text() for c in sorted(conditions, key=lambda c: (c.feature, c.op, str(c.value), c.values)))


def canonical_ids(rules: Sequence[Rule], prefix: str = "R") -> list[Rule]:
    """Stable ids: rules sorted by canonical text, numbered 1..n.  Duplicate
    texts collapse to one rule."""
    by_text = {}
    for r in rules:
        conds = tuple(sorted(r.conditions, key=lambda c: (c.feature, c.op, str(c.value), c.values)))
        by_text.setdefault(canonical_text(conds), conds)
    return [Rule(f"{prefix}{i}", conds) for i, (_, conds) in enumerate(sorted(by_text.items()), 1)]
