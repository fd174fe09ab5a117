"""Streaming over the groups of a table, with large groups cut into pairs of
chunks, so that no task holds a whole large group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import released


def chunk_pairs(members: DataFrame, key: str, id_col: str, count_col: str, chunk: int) -> DataFrame:
    """Add ``_i`` and ``_j`` (i <= j) and ``_c``: a unit of work for every pair of
    chunks of a group, with the rows of both chunks (``_c``: the row's chunk).
    Every pair of rows of a group meets in exactly one unit (rows of one chunk
    in the unit i = j).  Groups of up to ``chunk`` rows are one unit."""
    n = F.ceil(F.col(count_col) / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), n).cast("int")
    df = members.withColumn("_c", own).withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1)))
    return df.withColumns({"_i": F.least("_c", "_o"), "_j": F.greatest("_c", "_o")}).drop("_o")


def map_units(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], pa.RecordBatch | None]) -> DataFrame:
    """Deal rows out by ``keys`` and call ``work`` with all rows of each unit, in
    Arrow; a task holds one unit at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            if held:
                out = work(pa.Table.from_batches(held))
                held.clear()
                if out is not None and out.num_rows:
                    yield out

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_pylist() for k in keys]
            rows = list(zip(*cols))
            start = 0
            for i, k in enumerate(rows):
                if k != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield from flush()
                    start, last = i, k
            held.append(batch.slice(start))
        yield from flush()

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(released(run), schema)
