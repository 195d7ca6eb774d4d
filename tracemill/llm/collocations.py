"""Phrase collocations: word sequences that occur more often than their parts would have them meet.

Texts are cut into pieces at punctuation; equal pieces of a language become one row with its multiplicity. A slice of pieces is laid out as arrays of
words, its n-grams are added up with the pieces' multiplicities, and the sums go, compressed, to the hash buckets of their phrases (``BUCKETS`` for each shuffle
partition), where duckdb adds them up out of core: it reads the bucket as a stream, holds ``MEMORY`` and spills the rest to the task's scratch folder (beside Spark's own spill files;
removed when the task ends, and nothing else reads it). A phrase that occurs ``least`` times has parts that do so too, so only those are kept.

Each candidate then asks for the counts of its parts: requests are shuffled to the counts, answers back to the candidates. A part with more than 1 / HOT
of all words is answered by broadcast: there are HOT such parts of each length at most. Any other part is asked for by fewer than (its count / ``least``)
phrases on either side. The requests also tell a phrase the most frequent longer one it is in: it is the beginning or the end of one a word longer, and phrases further inside
of longer ones are inside of that one as often at least.

Defined results: a null text is empty, a null language is ``und``. Only A-Z are lower-cased. Ties of score and count are ranked by phrase, in the order of its bytes. Repeated rows count
each. An empty table, or one whose phrases are all rarer than ``least``, gives no rows. Columns besides ``text`` and ``lang`` are not read. A very long piece is one row and
is counted whole. Scores are exact for counts below 10^15.
"""

from __future__ import annotations

import itertools
import os
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .common import as_bytes, keep, slices, table

WORDS, LEAST, INSIDE, TOP = 3, 10, 50, 2_000
#: What duckdb may hold in one task.
MEMORY = "300MB"
#: Piece text whose n-grams are laid out at a time, in bytes.
SLICE = 8_000_000
#: Hash buckets for each shuffle partition: the smaller a bucket, the less duckdb spills.
BUCKETS = 3
HOT = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(rb"[.,;:!?\x0a-\x0d]+")


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (lower-cased words joined by one space), times: each distinct piece once."""

    def run(batches):
        for batch in slices(batches, most=SLICE):
            langs = batch.column("lang").to_pylist()
            found: Counter = Counter()
            for lang, text in zip(langs, as_bytes(batch), strict=True):
                for piece in _CUT.split(text.lower()):  # bytes: A-Z only
                    words = piece.split()
                    if words:
                        found[lang, b" ".join(words)] += 1
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in found], pa.string()), "piece": pa.array([p for _, p in found], pa.binary()).cast(pa.string()), "times": pa.array(found.values(), pa.int64())})

    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, piece string, times long")
    return each.groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def ngrams(text: list[bytes], times: np.ndarray, most: int):
    """(words in a phrase, phrases, how often, hashes) of all phrases of up to ``most`` words within the pieces, repeated phrases added up."""
    joined = np.frombuffer(b"\n".join(text) + b"\n", np.uint8)
    ends = np.flatnonzero((joined == 32) | (joined == 10))
    last = joined[ends] == 10
    data = joined[(joined != 32) & (joined != 10)]
    offsets = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    weight = np.repeat(times, np.diff(np.concatenate(([-1], np.flatnonzero(last)))))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    with np.errstate(over="ignore"):
        word_hash = np.add.reduceat((data + np.uint64(1)) * (_ODD * (2 * place.astype(np.uint64) + np.uint64(1))), offsets[:-1])
        word_hash = (word_hash ^ (word_hash >> np.uint64(29))) * _ODD
    phrases, start, hashes = words, np.arange(len(ends)), word_hash
    for n in range(1, most + 1):
        if n > 1:
            going = start + n - 1 < len(ends)
            going[going] = ~last[start[going] + n - 2]  # not past the end of the piece
            start = start[going]
            phrases = pc.binary_join_element_wise(phrases.filter(pa.array(going)), words.take(pa.array(start + n - 1)), pa.scalar(" ", pa.large_string()))
            hashes = hashes[going] * _ODD + word_hash[start + n - 1]
        if not len(start):
            return
        sums = pa.table({"phrase": phrases, "f": weight[start], "h": hashes}).group_by("phrase", use_threads=False).aggregate([("f", "sum"), ("h", "min")])
        yield n, sums["phrase"].combine_chunks(), sums["f_sum"].combine_chunks(), sums["h_min"].to_numpy()


def _joined(batches):
    """Batches of about ``SLICE`` bytes of pieces, put together from smaller ones or cut from larger ones."""
    held, size = [], 0
    for batch in slices(batches, "piece", SLICE):
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _slice_counts(most: int, buckets: int):
    """Counts of a slice, one compressed row for each hash bucket. Its sections are the languages' phrases of one length: the counts, then the phrases with a line end each."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in _joined(batches):
            lang_of = np.array(batch.column("lang").to_pylist(), object)
            text, times = as_bytes(batch, "piece"), batch.column("times").to_numpy(zero_copy_only=False)
            sections: dict[int, list] = {}
            for lang in dict.fromkeys(lang_of.tolist()):
                rows = np.flatnonzero(lang_of == lang)
                for size, phrases, f, h in ngrams([text[i] for i in rows], times[rows], most):
                    bucket = ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    counts = f.to_numpy()[order].astype(np.int64)
                    lines = pc.binary_join_element_wise(phrases.take(pa.array(order)), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
                    at, data = np.frombuffer(lines.buffers()[1], np.int64)[: len(lines) + 1], lines.buffers()[2]
                    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)):
                        i, j = cuts[b], cuts[b + 1]
                        sections.setdefault(int(b), []).append((lang, size, int(j - i), counts[i:j].tobytes() + data[int(at[i]) : int(at[j])].to_pybytes()))
            out = []
            for b, parts in sections.items():
                langs, sizes, ns, raw = zip(*parts, strict=True)
                out.append((b, list(langs), list(sizes), list(ns), list(map(len, raw)), codec.compress(b"".join(raw), asbytes=True)))
                sections[b] = None
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, t), v in zip(_PACKED.items(), zip(*out, strict=True), strict=True)})

    return run


def _unpacked(batches):
    codec = pa.Codec("zstd")
    for batch in batches:
        for row in batch.to_pylist():
            raw, start = codec.decompress(row["data"], sum(row["bytes"]), asbytes=True), 0
            for lang, size, n, length in zip(row["lang"], row["size"], row["n"], row["bytes"], strict=True):
                counts = np.frombuffer(raw, np.int64, n, start)
                lines = np.frombuffer(raw, np.uint8, length - 8 * n, start + 8 * n)
                start += length
                ends = np.flatnonzero(lines == 10)
                offsets = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int64)
                phrases = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(lines[lines != 10])])
                yield pa.RecordBatch.from_pydict({"lang": pa.repeat(pa.scalar(lang, pa.string()), n), "size": pa.repeat(pa.scalar(size, pa.int32()), n), "phrase": phrases.cast(pa.string()), "f": counts})


def _bucket_counts(least: int, memory: str):
    """Adds up one hash bucket in duckdb; a row of size 0 for each language has the words counted here, frequent or not."""

    def run(batches):
        import duckdb

        rows = _unpacked(batches)
        first = next(rows, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory(prefix="counts-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as scratch:
            with duckdb.connect(config={"memory_limit": memory, "temp_directory": scratch, "threads": 1, "preserve_insertion_order": False}) as db:
                db.register("parts", pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], rows)))
                words: Counter = Counter()
                sums = db.sql("SELECT lang, any_value(size) AS size, phrase, CAST(sum(f) AS BIGINT) AS f FROM parts GROUP BY lang, phrase")
                for out in sums.to_arrow_reader(50_000):
                    one = out.filter(pc.equal(out.column("size"), 1))
                    for row in pa.table({"lang": one.column("lang"), "f": one.column("f")}).group_by("lang").aggregate([("f", "sum")]).to_pylist():
                        words[row["lang"]] += row["f_sum"]
                    out = out.filter(pc.greater_equal(out.column("f"), least))
                    yield pa.RecordBatch.from_arrays([out.column(c).cast(t) for c, t in _SHAPE.items()], names=list(_SHAPE))
                if words:
                    n = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([0] * n, pa.int32()), pa.array([""] * n, pa.string()), pa.array(words.values(), pa.int64())], names=list(_SHAPE))

    return run


_PACKED = {"bucket": pa.int32(), "lang": pa.list_(pa.string()), "size": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "bytes": pa.list_(pa.int64()), "data": pa.binary()}
_SHAPE = {"lang": pa.string(), "size": pa.int32(), "phrase": pa.string(), "f": pa.int64()}


def frequent(docs: DataFrame, most: int = WORDS, least: int = LEAST, memory: str = MEMORY) -> DataFrame:
    """lang, size, phrase, f of every phrase of up to ``most`` words that occurs ``least`` times; rows of size 0 add up to a language's words."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces(docs).mapInArrow(_slice_counts(most, buckets), "bucket int, lang array<string>, size array<int>, n array<int>, bytes array<bigint>, data binary")
    return keep(parts.repartition(buckets, "bucket").mapInArrow(_bucket_counts(least, memory), "lang string, size int, phrase string, f long"), "phrase-counts")


def scored(counts: DataFrame, most: int = WORDS) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, by its weakest cut; ``inside``: the most often that a longer phrase around it occurs, else null."""
    total = counts.where("size = 0").agg(F.sum("f")).first()[0] or 0
    counts = counts.where("size > 0")
    words = F.split("phrase", " ")
    piece = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    k = F.col("k")
    asked = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    asked = asked.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), k.alias("n"), piece(F.lit(1), k).alias("part")), F.struct(F.lit(1).alias("side"), (F.col("size") - k).alias("n"), piece(k + 1, F.col("size") - k).alias("part")))).alias("x"))
    asked = asked.select("lang", "phrase", "a", "k", "x.*")
    known = counts.where(F.col("size") < most).select("lang", F.col("phrase").alias("part"), "f")
    hot = known.where(F.col("f") > total // HOT)
    near = asked.join(F.broadcast(hot), ["lang", "part"], "left")
    far = near.where("f is null").drop("f").join(known.where(F.col("f") <= total // HOT), ["lang", "part"])
    answers = near.where("f is not null").unionByName(far)
    cut = lambda j, side: F.max(F.when((k == j) & (F.col("side") == side), F.col("f")))
    sides = [cut(j, side).alias(f"{'lr'[side]}{j}") for j in range(1, most) for side in (0, 1)]

    def score(j: int):
        value = F.expr(f"(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000) div (cast(l{j} as decimal(19,0)) * cast(r{j} as decimal(19,0)))")
        return F.when(F.col(f"l{j}").isNotNull(), F.struct(value.cast("long").alias("score"), F.lit(j).alias("k"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))

    weakest = F.array_min(F.array(*[score(j) for j in range(1, most)]))
    rows = answers.groupBy("lang", "phrase", "a").agg(*sides).select("lang", "phrase", "a", weakest.alias("w"))
    around = asked.where("n > 1").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("inside"))
    return rows.join(around, ["lang", "phrase"], "left").select("lang", "phrase", "a", "w.l", "w.r", "w.score", "inside")


def collocations(docs: DataFrame, *, words: int = WORDS, least: int = LEAST, inside: int = INSIDE, top: int = TOP, memory: str = MEMORY) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``words`` words.

    A phrase that in ``inside`` percent of its places or more stands in one longer phrase gives way to it.
    """
    counts = frequent(docs, words, least, memory)
    own = scored(counts, words).where(F.col("inside").isNull() | (100 * F.col("inside") < inside * F.col("a"))).drop("inside")
    best = numbered(own, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank", label="phrase-ranks").where(F.col("rank") <= top)
    n = counts.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
m AS (SELECT lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, (score, cut)) AS x FROM s GROUP BY ALL),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c t ON t.lang = c.lang AND t.k > c.k AND contains(' ' || t.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * t.a >= 50 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, phrase) AS rank, phrase, a, x.l AS l, x.r AS r, n, x.score::BIGINT AS score FROM m JOIN n USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM d) QUALIFY rank <= 2000"""
