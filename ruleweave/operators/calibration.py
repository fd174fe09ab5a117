"""Calibration tables – mean predicted risk vs actual event share per
risk bin, for all models and data sets in one aggregate (the reference runs
one filter per bin, per model, per data set)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import RISK_BREAKS, RISK_LABELS, equal_count_bins, fixed_bin_label


def with_fixed_bins(preds: DataFrame, prob: str = "prob", out: str = "bin",
                    breaks: Sequence[float] = RISK_BREAKS,
                    labels: Sequence[str] = RISK_LABELS) -> DataFrame:
    """A11 on predictions: bin label from fixed right-closed breaks."""
    return preds.withColumn(out, fixed_bin_label(prob, breaks, labels))


def with_quantile_bins(preds: DataFrame, group_cols: Sequence[str], prob: str = "prob",
                       k: int = 5, out: str = "bin", strict: bool = False) -> DataFrame:
    """A13 on predictions: equal-count bins per group (e.g. data set × model)."""
    return equal_count_bins(preds, prob, k, group_cols, out=out, strict=strict)


def calibration(preds: DataFrame, group_cols: Sequence[str], bin_col: str = "bin",
                prob: str = "prob", label: str = "y", event_label: int = 0,
                long: bool = True) -> DataFrame:
    """Per group and bin: n, mean predicted, actual event share.  ``long``
    returns the reference's shape (group…, bin, var ∈ {Actual, Predicted},
    value)."""
    g = list(group_cols)
    wide = (preds.filter(F.col(bin_col).isNotNull())
            .groupBy(*g, bin_col)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.avg(prob).alias("Predicted"),
                 F.avg((F.col(label) == F.lit(event_label)).cast("double")).alias("Actual")))
    if not long:
        return wide
    return wide.unpivot([*g, bin_col, "n"], ["Actual", "Predicted"], "var", "value")
