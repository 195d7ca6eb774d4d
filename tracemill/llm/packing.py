"""Best-fit packing planned on a histogram of lengths.

One pass turns documents into pieces of at most ``capacity`` tokens and numbers the pieces of each length within their task.
The pieces are written to the shared folder, so that the numbers stay as they are whatever executors are lost. The driver
sees counts per length only (at most ``capacity`` rows) and plans best-fit decreasing on them: sequences with the same free
space are interchangeable, so a plan row moves a whole range of sequences at once. Pieces then take their slot by rank
within length: the count of that length in earlier tasks (a small table, joined by task and length) plus the number in the task.

Defined results: null and empty texts give one piece, the end id alone; repeated rows are packed each; an empty table gives no
rows; only doc_id and text are read, whatever other columns are called. Documents over the capacity are cut so that only the first
piece may be shorter. Very long texts and runs take time in proportion to their length and are held in memory one at a time.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, slices, table
from .token_counts import byte_symbols

CAPACITY = 1024
END_ID = 2
#: Characters of white space, or of none, in a row.
LONG_RUN = 5_000
_LONG = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The vocabulary of a tokenizers file in tiktoken's encoder, which gives the same ids several times faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    value = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(value[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), special


@functools.lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text. One with a long run takes the library itself, whose scanner needs no stack for it; the ids are the same both ways."""
    if len(text) >= LONG_RUN and _LONG.search(text):
        return library(path).encode(text, add_special_tokens=False).ids
    enc, special = encoder(path, pattern)
    return enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first rank, pieces, first sequence, pieces in a sequence, offset): piece ``k`` of a row goes to sequence
    ``first + k // per`` at ``offset + (k % per) * length``.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> ranges (first sequence, how many)
    plan, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = next((s for s in range(length, capacity + 1) if free.get(s)), None)
            if space is None:
                break
            first, n = free[space].pop()
            take = min(n, left)
            if take < n:
                free[space].append((first + take, n - take))
            plan.append((length, rank, take, first, 1, capacity - space))
            free[space - length].append((first, take))
            rank, left = rank + take, left - take
        per = capacity // length
        full, rest = divmod(left, per)
        if full:
            plan.append((length, rank, full * per, bins, per, 0))
            free[capacity - per * length].append((bins, full))
            bins, rank = bins + full, rank + full * per
        if rest:
            plan.append((length, rank, rest, bins, rest, 0))
            free[capacity - rest * length].append((bins, 1))
            bins += 1
    return plan


def pieces(docs: DataFrame, vocabulary: str, pattern: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (task, nth): the piece's number among those of its length in its task."""

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or "", vocabulary, pattern), end_id], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, vocabulary: str, pattern: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = keep(pieces(docs, vocabulary, pattern, capacity=capacity, end_id=end_id), "pieces")
    by_task = keep(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = np.array(sorted(make_plan(histogram, capacity)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(plan)  # at most a row for each pair of a length and a free space
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches):
        rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1].reshape(-1, 6)
            k = rank - at[:, 1]
            cols = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols |= {"sequence_id": pa.array(at[:, 3] + k // at[:, 4], pa.int64()), "offset": pa.array(at[:, 5] + k % at[:, 4] * length, pa.int64())}
            yield pa.RecordBatch.from_pydict(cols)

    ids = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {ids}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
