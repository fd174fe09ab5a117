"""Column helpers for categories, recodes, casts and NULL-aware predicates
(P1, P2, P6, P7, P10, P12, P15, P17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_nominal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Treat columns as unordered categories (text)."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def level_code(col: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of the value in an ordered level list.

    A value outside the list (or NULL) gives NULL, like an R ordered factor
    gives NA.  ``array_position`` runs inside codegen; no join needed for a
    level list of a few dozen entries.
    """
    c = F.col(col) if isinstance(col, str) else col
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), c.cast("string"))
    return F.when(pos > 0, pos.cast("int"))


def with_ordered(df: DataFrame, col: str, levels: Sequence[str],
                 code_col: str | None = None) -> DataFrame:
    """Keep the text and add its level code (``<col>_code``); values not in
    the list become NULL in both columns."""
    code_col = code_col or f"{col}_code"
    code = level_code(col, levels)
    return df.withColumns({code_col: code, col: F.when(code.isNotNull(), F.col(col))})


def recode(col: str | Column, mapping: Mapping[str, object | None],
           otherwise: Column | None = None) -> Column:
    """Value recode through a literal map (``create_map``): text → score
    or code → label.  Keys mapped to ``None`` become NULL; values not in the
    map keep ``otherwise`` (default: NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    # try_element_at: a missing key gives NULL also under ANSI mode
    looked = F.try_element_at(F.create_map(*kv), c) if kv else F.lit(None)
    if otherwise is None:
        return looked
    in_map = F.array_contains(F.map_keys(F.create_map(*kv)), c) if kv else F.lit(False)
    return F.when(in_map, looked).otherwise(otherwise)


def to_number(col: str | Column, dtype: str = "double") -> Column:
    """Text → number; unparsable text gives NULL (R gives NA)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").try_cast(dtype)


def in_set(col: str | Column, values: Sequence[object]) -> Column:
    """P10: ``x %in% values`` with R semantics: NULL x gives FALSE."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(list(values)), F.lit(False))


def not_in_set(col: str | Column, values: Sequence[object]) -> Column:
    """P10: ``!(x %in% values)``: NULL x gives TRUE (R semantics)."""
    return ~in_set(col, values)


def keep_rank(col: str | Column, k: int) -> Column:
    """``rank <= k | is.na(rank)`` – an unranked row is kept."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (c <= F.lit(k))


def prefixed_id(col: str | Column, prefix: str = "R") -> Column:
    """``paste0("R", id)``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(prefix), c.cast("string"))


def column_kind(df: DataFrame, col: str) -> str:
    """P17: 'numeric', 'category' or 'other' from the schema (driver side;
    reads only metadata)."""
    t = df.schema[col].dataType
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                      T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(t, (T.StringType, T.BooleanType)):
        return "category"
    return "other"
