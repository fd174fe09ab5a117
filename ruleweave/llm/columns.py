"""Input columns under names that cannot clash with an operator's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_aside(columns: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Expressions that take the columns under the names c0, c1, … and, for the
    end, those that give them their own names back."""
    aside = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    return aside, [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
