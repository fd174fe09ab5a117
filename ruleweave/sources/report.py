"""Rounded report tables written as CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round every double column (``formatRound(cols, digits)``)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def write_report(df: DataFrame, path: str, digits: int = 3, fmt: str = "csv") -> None:
    w = rounded(df, digits).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv"
                ) -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)
