"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised into word windows and put into one automaton; each document is
normalised once, scanned once, and the hits are mapped back to offsets of the original text.

Defined results: a null or empty text has no words and is clean; a null, empty or wordless item matches nothing; repeated
items count once by ``item_id``; repeated documents each get their row; an empty table gives no rows; other columns are ignored, or
kept as they are by ``decontaminate``, whatever they are called. A very long text is scanned once, in time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, table

WINDOW = 10
#: Characters of benchmark text in one automaton, which takes some 400 bytes for each in every worker; a larger benchmark is scanned in
#: blocks of this size.
BLOCK_CHARS = 1_000_000

#: Lower-cases A-Z and turns every byte that is no digit, letter or part of a non-ASCII character into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_windows(items: list[tuple], width: int = WINDOW) -> dict[bytes, set[str]]:
    """Normalised window -> ids of the items that have it."""
    out: dict[bytes, set[str]] = {}
    for item_id, text in items:
        w = words((text or "").encode())
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(b" ".join(w[i : i + width]), set()).add(str(item_id))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def build_automaton(windows: dict[bytes, set[str]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for window, ids in windows.items():
        # Latin-1 keeps one symbol per byte; the spaces around make hits start and end at words.
        automaton.add_word(f" {window.decode('latin-1')} ", (len(window) + 2, window.count(b" ") + 1, tuple(ids)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def scan(automaton, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges [from, to) of all hits, and the ids of the items hit."""
    if not tokens or not len(automaton):
        return [], set()
    norm = b" " + b" ".join(tokens) + b" "
    ranges, items, at, seen = [], set(), 0, 0
    hits = sorted((end - size + 1, n, ids) for end, (size, n, ids) in automaton.iter(norm.decode("latin-1")))
    for start, n, ids in hits:
        seen += norm.count(b" ", at, start)
        at = start
        ranges.append((seen, seen + n))
        items.update(ids)
    return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point offsets [start, end) of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_RANGES = pa.list_(pa.list_(pa.int64()))
_HITS = "n_words long, ranges array<array<bigint>>, items array<string>, spans array<array<bigint>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ``text`` and n_words, ranges (hit word ranges), items, spans (code-point offsets of ``ranges``).

    One narrow pass: no shuffle. What is broadcast is one automaton's windows, at most ``block_chars`` of items
    (and the last item); a larger benchmark takes one pass of the same stage for each block.
    """
    return _leaks(docs, F.col("doc_id"), benchmark, width, block_chars).withColumnRenamed("row", "doc_id")


def _leaks(docs: DataFrame, row, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The same with any column expression ``row`` in place of doc_id."""
    spark = docs.sparkSession
    df = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<bigint>>").alias("ranges"), F.array().cast("array<string>").alias("items"), F.array().cast("array<array<bigint>>").alias("spans"))

    def block_pass(windows):
        shared = spark.sparkContext.broadcast(windows)

        def run(batches):
            automaton = build_automaton(shared.value)
            for batch in batches:
                n_words, ranges, items, spans = [], [], [], []
                was, had = batch.column("ranges").to_pylist(), batch.column("items").to_pylist()
                texts = as_bytes(batch)
                for text, r0, i0 in zip(texts, was, had, strict=True):
                    tokens = words(text)
                    found, ids = scan(automaton, tokens)
                    both = merged([*map(tuple, r0), *found])
                    n_words.append(len(tokens))
                    ranges.append(both)
                    items.append(sorted({*i0, *ids}))
                    spans.append(original_spans(text.decode(), both))
                cols = {f.name: batch.column(f.name) for f in batch.schema}
                cols |= {"n_words": pa.array(n_words, pa.int64()), "ranges": pa.array(ranges, _RANGES), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, _RANGES)}
                yield pa.RecordBatch.from_pydict(cols)

        return run

    some = False
    for block in _blocks(benchmark, block_chars):
        some = True
        df = df.mapInArrow(block_pass(item_windows(block, width)), df.schema)
    return df if some else df.mapInArrow(block_pass({}), df.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    found = _leaks(docs, F.struct("*"), benchmark)
    return found.where(F.size("items") == 0).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _digest(batches):
    for batch in batches:
        ranges, items = batch.column("ranges").to_pylist(), batch.column("items").to_pylist()
        n_hit = [sum(b - a for a, b in r) for r in ranges]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
        })


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = found.schema["doc_id"].dataType.simpleString()
    return found.drop("text", "spans").mapInArrow(_digest, f"doc_id {ids}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
