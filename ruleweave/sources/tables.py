"""Loading stored tables with a schema check."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class SchemaError(ValueError):
    pass


def load_table(spark: SparkSession, path: str,
               required: dict[str, T.DataType | tuple] | Iterable[str] | None = None,
               ) -> DataFrame:
    """Read a Parquet table and check that the required columns exist (and,
    when types are given, that they have that type or one of a tuple of
    admissible types).

    The read is lazy: Catalyst later prunes columns and pushes filters into
    the Parquet scan, so a caller that selects two columns reads two.
    """
    df = spark.read.parquet(path)
    if required:
        fields = {f.name: f.dataType for f in df.schema.fields}
        items = required.items() if isinstance(required, dict) else ((c, None) for c in required)
        for name, dtype in items:
            if name not in fields:
                raise SchemaError(f"{path}: missing column {name!r}; has {sorted(fields)}")
            ok = dtype if isinstance(dtype, tuple) else (dtype,)
            if dtype is not None and fields[name] not in ok:
                want = " or ".join(t.simpleString() for t in ok)
                raise SchemaError(f"{path}: column {name!r} is {fields[name].simpleString()}, "
                                  f"expected {want}")
    return df


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str,
         required: dict[str, T.DataType] | Iterable[str] | None = None) -> DataFrame:
    """Read one of the driver tables (``<sf_dir>/<name>.parquet``)."""
    return load_table(spark, table_path(sf_dir, name), required)
