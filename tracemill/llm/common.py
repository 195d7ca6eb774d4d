"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, materialised as keep, read_table as table

__all__ = ["SLICE_BYTES", "apart", "as_bytes", "discard", "keep", "let", "running", "slices", "table"]

#: Text handled at a time inside a Python task, in bytes; bounds the worker's memory whatever the batch size.
SLICE_BYTES = 2_000_000


def apart(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns as one struct ``row`` beside ``more``, so that no name of theirs meets a name of an operator's own."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in more.items()])


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), body), 0)


def running(values: Column, op: Callable[[Column, Column], Column], neutral: int) -> Column:
    """``op`` over each beginning of a long array, by doubling distances: n log n steps, and no array is built up element by element."""

    def run(v: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(2)).cast("double"))).cast("int") - 1)
        step = lambda acc, j: F.transform(acc, lambda x, i: op(x, F.coalesce(F.get(acc, i - F.pow(F.lit(2), j).cast("int")), F.lit(neutral).cast("long"))))
        return F.aggregate(rounds, v, step)

    return let(values.cast("array<bigint>"), run)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each; a longer single text stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = batch.column(column).cast(pa.binary()).to_pylist()
        start = total = 0
        for i, x in enumerate(sizes):
            size = len(x) if x is not None else 0
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
