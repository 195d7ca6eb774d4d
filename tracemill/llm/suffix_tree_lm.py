"""LM scoring with a probabilistic suffix tree over words.

A context is the last one, two, three or more words before a position. The tree grows level by level: contexts of d + 1 words are
tried below the retained ones of d words, and growth ends when no context is left to try. A context is tried if it was seen ``LEAST``
times; it stays if its next-word distribution diverges enough from its longest suffix's (Kullback-Leibler divergence above
``MIN_DIVERGENCE``, and times the count above ``MIN_GAIN``), so the tree follows the corpus in size and in depth. It lists the next words that it saw ``CUT`` times and takes the
others from its suffix; distributions are smoothed with the suffix's by absolute discounting, and the root is the discounted word
distribution, in which all words that training lacks are one symbol, as they are in the base score.

The tree is a table of the shared folder. A position's score is the root's log probability plus one term for each retained context
of its chain: what the context gives up to its suffix, and for a next word that it lists what that adds. So a text's score is a sum
over keys (64-bit hashes of words, of contexts, and of contexts with next words). The most frequent keys, ``HOT_KEYS`` of each kind
at most, are broadcast; all others meet the tree by key. Bitmaps of fixed size only keep keys that the tree can't have out of the
shuffles: a false hit is settled by the tables. Texts are scored in ``WAVES`` rounds, dealt by their ids, so that the look-ups of one
round at most are on disk.

Rows with one number each would cost more than the work on them, so tasks hand on sorted arrays, one for each range of keys
(``parts`` of them, in proportion to the corpus): Spark shuffles the arrays by range, and a range's arrays are merged by numpy.

Rows are numbered within their task: ``docs`` must give a task's rows in the same order whenever it is computed, as files do;
what comes from a shuffle has to be written first.

Words are told apart by 64-bit hashes: of a billion distinct words two share one with a chance of 3 %; these would share their count.

Defined results: a null or empty text is the end symbol alone; repeated rows each get their row; with no training rows the model is
uniform and all counts are 0; an empty table gives no rows; only doc_id and text are read, whatever other columns are called. A very
long text is held in memory with its positions, some 100 bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, keep, slices, table
from .near_dedup import _M1, _M2, _mix

#: So many of the most frequent keys of words, and of contexts and entries, are broadcast at most.
HOT_KEYS = 300_000
#: Times that a context must be seen to be tried, and a next word to be listed.
LEAST, CUT = 4, 3
#: Nats that a context must save to become a node of the tree: in all (count x divergence), and for each time it was seen.
MIN_GAIN, MIN_DIVERGENCE = 8.0, 0.2
#: What each listed word's count gives up to the suffix's distribution.
DISCOUNT = 0.75
#: log2 of the most bits of a bitmap; with fewer keys it has 16 bits for each.
BITS = 27
#: Training tokens for each range of keys, and the fewest ranges.
PART_TOKENS, LEAST_PARTS = 2_000_000, 64
HELD = (7, 2)
#: Keys that a task collects before it hands them on.
FLUSH = 500_000
#: Texts are scored in so many rounds, so that only a share of all look-ups is on disk at a time.
WAVES = 4

ENTRY = np.dtype([("context", "<u8"), ("next", "<u8"), ("n", "<u4")])
CONTEXT = np.dtype([("context", "<u8"), ("suffix", "<u8"), ("of", "<u8")])
LISTED = np.dtype([("up", "<u8"), ("k", "<u8"), ("context", "<u8"), ("n", "<u8"), ("of", "<u8"), ("free", "<f8")])
RATED = np.dtype([*LISTED.descr, ("above", "<f8"), ("own", "<f8")])
TERM = np.dtype([("k", "<u8"), ("n", "<u8"), ("w", "<f8"), ("p", "<f8")])
WEIGHT = np.dtype([("k", "<u8"), ("w", "<f8"), ("n", "<u8")])
GROWTH = np.dtype([("suffix", "<u8"), ("k", "<u8"), ("n", "<u8")])
LOOKUP = np.dtype([("k", "<u8"), ("row", "<u4")])
SUMS = np.dtype([("row", "<u4"), ("known", "<u4"), ("log", "<f8"), ("score", "<f8")])
_BLOBS = "kind string, part int, blob binary"


def is_held_out(doc_id: object, parts: tuple[int, int] = HELD) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts[0] == parts[1]


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``_mix``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(int(_M2), -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(int(_M1), -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def context_of(gram: np.ndarray, level: int) -> np.ndarray:
    """Key of a context of ``level`` words: ``gram`` is its one word's hash, or the entry of its words before the last with the last."""
    return _mix(gram + np.uint64(level))


def entry_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(context ^ word)


#: The low bytes of a 64-bit number, none to all eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The seed of the numbers of the places in a word.
_PLACE = np.uint64(0xD1B54A32D192ED03)
#: Pieces of words hashed at a time.
STEP = 1_000_000


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a lower-cased text: the sum over its pieces of eight bytes, each mixed with its place's number, and its length, mixed."""
    raw = np.frombuffer(text + bytes(8), np.uint8)
    inside = (raw != 32) & ((raw - np.uint8(9)) > 4)
    inside[len(text) :] = False
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, length = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum((length + 7) >> 3)
    begins = ends - ((length + 7) >> 3)
    eight = np.ndarray((len(text) + 1,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    sums = length.astype(np.uint64)
    for at in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        words = slice(np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + STEP))
        first = np.maximum(begins[words], at)
        n = np.minimum(ends[words], at + STEP) - first
        place = np.arange(first[0], first[0] + n.sum()) - np.repeat(begins[words], n)
        left = np.repeat(length[words], n) - 8 * place
        pieces = eight[np.repeat(starts[words], n) + 8 * place] & _LOW[np.minimum(left, 8)]
        sums[words] += np.add.reduceat(_mix(pieces ^ _mix(place.astype(np.uint64) + _PLACE)), first - first[0])
    return _mix(sums), starts


#: Hashes of what is before a text and after it; no word has white space.
BEFORE, AFTER = _mix(_mix(np.array([32, 10], np.uint64)))


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's with what is before and after it; and the number of words of each text."""
    h, starts = word_hashes(b"\n".join(texts).lower())
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends)
    n = np.diff(last, prepend=0)
    at = np.repeat(np.arange(len(texts)) * 2 + 1, n) + np.arange(len(h))
    out = np.full(len(h) + 2 * len(texts), AFTER)
    out[at] = h
    out[last - n + np.arange(len(texts)) * 2] = BEFORE
    return out, n


def keys_at(h: np.ndarray, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(context, entry, entry a level below) of some positions. A text's first position has garbage from its second level on, which no table has."""
    gram, below = h[at - level], None
    for k in range(1, level + 1):
        context = context_of(gram, k)
        gram = entry_of(context, h[at - level + k])
    if level > 1:
        below = h[at - level + 1]
        for k in range(1, level):
            below = entry_of(context_of(below, k), h[at - level + 1 + k])
    return context, gram, below


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(44)) * np.uint64(parts) >> np.uint64(20)).astype(np.int64)


def blobs(kind: str, rows: np.ndarray, by: str, parts: int) -> list[tuple[str, int, bytes]]:
    """One array for each range of the column ``by``."""
    part = part_of(rows[by], parts).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    return [(kind, p, rows[order[ends[p] : ends[p + 1]]].tobytes()) for p in np.flatnonzero(np.diff(ends)).tolist()]


def _batch(rows: list[tuple]) -> pa.Table:
    kinds, parts, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.string()), "part": pa.array(parts, pa.int32()), "blob": pa.array(data, pa.binary())})


def _array(t: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("blob").to_pylist()), dtype)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``keys`` is, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def lookups(rows: np.ndarray, parts: int) -> list[tuple[str, int, bytes]]:
    """Keys to look up, for each range in the order of their rows; the rows are packed as differences."""
    part = part_of(rows["k"], parts).astype(np.uint64)
    rows = rows[np.argsort(part << np.uint64(32) | rows["row"])]
    ends = np.searchsorted(np.sort(part), np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(ends)).tolist():
        x = rows[ends[p] : ends[p + 1]]
        out.append(("", p, len(x).to_bytes(8, "little") + x["k"].tobytes() + zlib.compress(np.diff(x["row"], prepend=np.uint32(0)).tobytes(), 1)))
    return out


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(blob, np.uint64, n, 8), np.cumsum(np.frombuffer(zlib.decompress(blob[8 + 8 * n :]), np.uint32), dtype=np.uint32)


def packed_entries(rows: np.ndarray, parts: int) -> list[tuple[str, int, bytes]]:
    """Entries for each range in the order of their contexts: these as packed differences, the counts packed, the next words as they are."""
    rows = rows[np.argsort(rows["context"])]
    ends = np.searchsorted(part_of(rows["context"], parts), np.arange(parts + 1))  # ranges follow the order of the keys
    out = []
    for p in np.flatnonzero(np.diff(ends)).tolist():
        x = rows[ends[p] : ends[p + 1]]
        contexts = zlib.compress(np.diff(x["context"], prepend=np.uint64(0)).tobytes(), 1)
        out.append(("entry", p, len(x).to_bytes(8, "little") + len(contexts).to_bytes(8, "little") + x["next"].tobytes() + contexts + zlib.compress(x["n"].tobytes(), 1)))
    return out


def unpacked_entries(t: pa.Table) -> np.ndarray:
    made = []
    for blob in t.column("blob").to_pylist():
        n, size = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
        at = 16 + 8 * n
        x = np.zeros(n, ENTRY)
        x["context"] = np.cumsum(np.frombuffer(zlib.decompress(blob[at : at + size]), "<u8"), dtype=np.uint64)
        x["next"], x["n"] = np.frombuffer(blob, "<u8", n, 16), np.frombuffer(zlib.decompress(blob[at + size :]), "<u4")
        made.append(x)
    return np.concatenate(made) if made else np.zeros(0, ENTRY)


def meet(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str = _BLOBS, by: str = "part") -> DataFrame:
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(f, schema)


def of_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("kind") == kind).select("part", "blob")


def kept_kind(df: DataFrame, kind: str) -> DataFrame:
    """One kind of a table that was written by kinds, to be deleted alone."""
    out = of_kind(df, kind)
    out.written_to = f"{df.written_to}/kind={kind}"
    return out


def bitmap(df: DataFrame, dtype: np.dtype, column: str, parts: int) -> np.ndarray:
    """2 ** BITS bits at most, set where a key begins with these bits; each range of keys makes its own."""
    n = (df.agg(F.sum(F.length("blob"))).first()[0] or 0) // dtype.itemsize
    log = min(BITS, max(17, int(np.ceil(np.log2(16 * n + 1)))))
    size = (1 << log) // parts

    def run(t: pa.Table) -> pa.Table:
        keys = _array(t, dtype)[column]
        bits = np.zeros(size, np.uint8)
        bits[((keys >> np.uint64(64 - log)) & np.uint64(size - 1)).astype(np.int64)] = 1
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((parts, size // 8), np.uint8)
    found = df.groupBy("part").applyInArrow(run, "part int, bits binary").toArrow()
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - int(np.log2(8 * len(bits))))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_entries(docs: DataFrame, level: int, parts: int, shared, held: tuple[int, int] = HELD) -> DataFrame:
    """Arrays of (context, next, n) over the training documents, by context. ``shared``: broadcast bitmaps of the contexts tried, from two words on, and of the entries listed a level below."""

    def run(batches):
        found = []

        def out():
            context, nxt, k = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.argsort(k)
            first = _runs(k[order])
            rows = np.zeros(len(first), ENTRY)
            rows["n"] = np.diff(np.append(first, len(k)))
            rows["context"], rows["next"] = context[order[first]], nxt[order[first]]
            yield from _batch(packed_entries(rows, parts)).to_batches()

        for batch in slices(batches, most=1_000_000):
            texts = [t for i, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch), strict=True) if not is_held_out(i, held)]
            if not texts:
                continue
            h, _ = read(texts)
            at = np.flatnonzero(h != BEFORE)
            for k in range(2, level + 1):  # a context is tried below a tried one only
                at = at[_in(shared.value[0][k - 2], keys_at(h, at, k)[0])]
            context, entry, up = keys_at(h, at, level)
            if shared:
                some = _in(shared.value[1], up)
                context, entry, at = context[some], entry[some], at[some]
            found.append((context, h[at], entry))
            if sum(len(x[0]) for x in found) > FLUSH:
                yield from out()
        if found:
            yield from out()

    return docs.mapInArrow(run, _BLOBS)


def listed(entries: DataFrame, contexts: DataFrame | None, level: int, parts: int) -> DataFrame:
    """Kinds ``listed`` (by the suffix's entry) and, at level 1, ``word`` (k, n) and ``total`` (how many words, and their sum)."""

    is_root = contexts is None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        e = unpacked_entries(left)
        k = entry_of(e["context"], e["next"])
        order = np.lexsort((k, e["context"]))
        e, k = e[order], k[order]
        first = _runs(k)
        n, context, nxt, k = np.add.reduceat(e["n"].astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64), e["context"][first], e["next"][first], k[first]
        out = []
        if is_root:  # a word is followed as often as it occurs, a text's end as often as its beginning
            begin = _runs(context)
            of = np.add.reduceat(n, begin) if len(begin) else n
            words = np.zeros(len(begin), TERM)
            words["k"], words["n"] = _unmix(context[begin]) - np.uint64(1), of
            words["k"][words["k"] == BEFORE] = AFTER
            out += blobs("word", words, "k", parts)
            out.append(("total", 0, np.array([len(words), of.sum()], np.uint64).tobytes()))
            c = np.zeros(len(begin), CONTEXT)
            c["context"], c["of"] = context[begin], of
            c = c[of >= LEAST]
        else:
            c = _array(right, CONTEXT)
            c = c[np.argsort(c["context"])]
        at, known = _find(c["context"], context)
        some = np.flatnonzero(known & (n >= CUT))
        rows = np.zeros(len(some), LISTED)
        at = at[some]
        rows["k"], rows["context"], rows["n"] = k[some], context[some], n[some]
        if len(some):
            rows["of"] = c["of"][at]
            rows["up"] = nxt[some] if level == 1 else entry_of(c["suffix"][at], nxt[some])
            begin = _runs(rows["context"])
            given = np.add.reduceat(rows["n"] - DISCOUNT, begin)
            rows["free"] = 1 - np.repeat(given, np.diff(np.append(begin, len(rows)))) / rows["of"]
        return _batch(out + blobs("listed", rows, "up", parts))

    return meet(entries.select("part", "blob"), entries.select("part", "blob").limit(0) if is_root else contexts, run)


def rated(rows: DataFrame, below: DataFrame, parts: int) -> DataFrame:
    """Kind ``rated``, by context: listed entries with the suffix's probability and their own."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, b = _array(left, LISTED), _array(right, TERM)
        b = b[np.argsort(b["k"])]
        at, known = _find(b["k"], x["up"])
        x, out = x[known], np.zeros(int(known.sum()), RATED)
        for c in LISTED.names:
            out[c] = x[c]
        if len(out):
            out["above"] = b["p"][at[known]]
            out["own"] = (x["n"] - DISCOUNT) / x["of"] + x["free"] * out["above"]
        return _batch(blobs("rated", out, "context", parts))

    return meet(rows, below, run)


def settled(rows: DataFrame, level: int, parts: int) -> DataFrame:
    """The divergence test. Kinds ``term`` (by key: what is looked up), ``stay`` (the retained contexts) and ``grow`` (by suffix: longer contexts seen often enough)."""
    def run(t: pa.Table) -> pa.Table:
        x = _array(t, RATED)
        x = x[np.argsort(x["context"], kind="stable")]
        begin = _runs(x["context"])
        ends = np.diff(np.append(begin, len(x)))
        head = x[begin]
        gain = np.add.reduceat(x["n"] * np.log(x["own"] / x["above"]), begin) if len(x) else np.zeros(0)
        seen = np.add.reduceat(x["n"], begin) if len(x) else np.zeros(0)
        gain = gain + (head["of"] - seen) * np.log(head["free"])
        stay = (gain > MIN_GAIN) & (gain > MIN_DIVERGENCE * head["of"])
        own = x[np.repeat(stay, ends)]
        contexts, terms = np.zeros(int(stay.sum()), TERM), np.zeros(len(own), TERM)
        contexts["k"], contexts["n"], contexts["w"], contexts["p"] = head["context"][stay], head["of"][stay], np.log10(head["free"][stay]), np.nan
        terms["k"], terms["n"], terms["w"], terms["p"] = own["k"], own["n"], np.log10(own["own"]) - np.log10(own["above"]) - np.log10(own["free"]), own["own"]
        more = x[(x["n"] >= LEAST) & ((x["up"] != AFTER) if level == 1 else np.True_)]
        growth = np.zeros(len(more), GROWTH)
        growth["suffix"], growth["k"], growth["n"] = context_of(more["up"], level), more["k"], more["n"]
        return _batch(blobs("term", np.concatenate([contexts, terms]), "k", parts) + blobs("stay", contexts, "k", parts) + blobs("grow", growth, "suffix", parts))

    return rows.groupBy("part").applyInArrow(run, _BLOBS)


def longer(growth: DataFrame, stay: DataFrame, level: int, parts: int) -> DataFrame:
    """Contexts of ``level`` + 1 words below retained ones."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, s = _array(left, GROWTH), np.sort(_array(right, TERM)["k"])
        x = x[_find(s, x["suffix"])[1]]
        out = np.zeros(len(x), CONTEXT)
        out["context"], out["suffix"], out["of"] = context_of(x["k"], level + 1), x["suffix"], x["n"]
        return _batch(blobs("context", out, "context", parts))

    return meet(growth, stay, run)


def _words(rows: DataFrame, total: int, kinds: int) -> DataFrame:
    """The root as terms: log probabilities less that of the symbol for all words that training lacks."""
    unseen = DISCOUNT * kinds / total

    def run(batches):
        for batch in batches:
            out = []
            for blob in batch.column("blob").to_pylist():
                x = np.frombuffer(blob, TERM).copy()
                x["p"] = (x["n"] - DISCOUNT) / total
                x["w"] = np.log10(x["p"]) - np.log10(unseen)
                out.append(x.tobytes())
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "blob": pa.array(out, pa.binary())})

    return rows.mapInArrow(run, "part int, blob binary")


class Tree:
    """``words`` and ``terms``: tables of TERM arrays by ranges of their keys; the counts of the base score; ``depth``: the words of the longest contexts."""

    def __init__(self, words: DataFrame, terms: DataFrame, total: int, kinds: int, depth: int, parts: int):
        self.words, self.terms, self.total, self.kinds, self.depth, self.parts = words, terms, total, kinds, depth, parts


def grow(docs: DataFrame, held: tuple[int, int] = HELD, parts: int | None = None) -> Tree:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if parts is None:  # white space is a bound of the words
        n = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(LEAST_PARTS, 1 << max(0, int(np.ceil(np.log2(max(1, n / 6 / PART_TOKENS))))))
    terms, contexts, shared, level, tried = [], None, None, 1, []
    while True:
        found = keep(listed(count_entries(docs, level, parts, shared, held), contexts, level, parts), f"tree-listed-{level}")
        if level == 1:
            totals = [np.frombuffer(r[0], np.uint64) for r in of_kind(found, "total").select("blob").toLocalIterator()]  # a row for each range
            kinds, total = (int(sum(t[i] for t in totals)) for i in (0, 1))
            if not total:
                return Tree(of_kind(found, "word"), of_kind(found, "word"), 0, 0, 0, parts)
            words = keep(_words(of_kind(found, "word"), total, kinds), "tree-words")
        both = rated(of_kind(found, "listed"), words if level == 1 else of_kind(terms[-1], "term"), parts)
        terms.append(keep(settled(both.select("part", "blob"), level, parts), f"tree-terms-{level}", by="kind"))
        discard(found)
        if contexts is not None:
            discard(contexts)
        contexts = keep(longer(of_kind(terms[-1], "grow"), of_kind(terms[-1], "stay"), level, parts), f"tree-contexts-{level + 1}")
        discard(kept_kind(terms[-1], "grow"), kept_kind(terms[-1], "stay"))
        if contexts.isEmpty():
            discard(contexts)
            break
        contexts_only = contexts.select("part", "blob")
        contexts_only.written_to = contexts.written_to
        contexts, level = contexts_only, level + 1
        if shared:
            shared.destroy()
        tried.append(bitmap(contexts, CONTEXT, "context", parts))
        shared = spark.sparkContext.broadcast((tried, bitmap(of_kind(terms[-1], "term"), TERM, "k", parts)))
    if shared:
        shared.destroy()
    found = of_kind(terms[0], "term")
    for t in terms[1:]:
        found = found.unionByName(of_kind(t, "term"))
    return Tree(words, found, total, kinds, level, parts)


def _weights(df: DataFrame, are_words: bool) -> DataFrame:
    """What look-ups need; contexts and entries have no count there."""

    def run(batches):
        for batch in batches:
            out = []
            for blob in batch.column("blob").to_pylist():
                t = np.frombuffer(blob, TERM)
                x = np.zeros(len(t), WEIGHT)
                x["k"], x["w"], x["n"] = t["k"], t["w"], t["n"] if are_words else 0
                out.append(x.tobytes())
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "blob": pa.array(out, pa.binary())})

    return df.mapInArrow(run, "part int, blob binary")


def _hot(df: DataFrame, most: int) -> np.ndarray:
    """The most frequent terms, sorted by key: those seen 2 ** j times or more, for the least j with at most ``most`` of them."""

    def sizes(batches):
        for batch in batches:
            n = np.concatenate([np.frombuffer(b, TERM)["n"] for b in batch.column("blob").to_pylist()] or [np.zeros(0)])
            j, c = np.unique(np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"j": pa.array(j, pa.int64()), "c": pa.array(c, pa.int64())})

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([x[x["n"] >= least].tobytes() for x in (np.frombuffer(b, TERM) for b in batch.column("blob").to_pylist())], pa.binary())})

    least, seen = None, 0
    for j, c in sorted(map(tuple, df.mapInArrow(sizes, "j long, c long").groupBy("j").agg(F.sum("c")).collect()), reverse=True):  # 64 rows at most
        seen += c
        if seen > most:
            break
        least = 2**j
    if least is None:
        return np.zeros(0, WEIGHT)
    rows = np.frombuffer(b"".join(df.mapInArrow(run, "blob binary").where(F.length("blob") > 0).toArrow().column("blob").to_pylist()), TERM)
    out = np.zeros(len(rows), WEIGHT)
    for c in WEIGHT.names:
        out[c] = rows[c]
    return out[np.argsort(out["k"])]


def score(docs: DataFrame, held: tuple[int, int] = HELD, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    tree = grow(docs, held, parts)
    parts, depth, total = tree.parts, tree.depth, tree.total
    unseen = float(np.log10(DISCOUNT * tree.kinds / total)) if total else 0.0
    empty = np.zeros(0, WEIGHT)
    shared = spark.sparkContext.broadcast((_hot(tree.words, HOT_KEYS) if total else empty, _hot(tree.terms, HOT_KEYS) if total else empty, bitmap(tree.terms, TERM, "k", parts) if total else None))

    def positions(batches):
        from pyspark import TaskContext

        hot_words, hot, bits = shared.value
        task, row, found = TaskContext.get().partitionId(), 0, []

        def out():
            cold = np.concatenate(found)
            found.clear()
            rows = lookups(cold, parts)
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([r[1] for r in rows], pa.int32()), "task": pa.array([task] * len(rows), pa.int32()), "row": none.cast(pa.int64()), "doc_id": none.cast(kind), "held_out": none.cast(pa.bool_()),
                "n_tokens": none.cast(pa.int64()), "known": none.cast(pa.int64()), "log": none.cast(pa.float64()), "score": none.cast(pa.float64()), "blob": pa.array([r[2] for r in rows], pa.binary()),
            })

        for batch in slices(batches, most=1_000_000):
            ids, kind = batch.column("doc_id").to_pylist(), batch.column("doc_id").type
            h, n = read(as_bytes(batch))
            n = n + 1
            here = np.flatnonzero(h != BEFORE)
            text = np.repeat(np.arange(len(ids)), n)
            known, log, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids)), n * unseen

            def look(keys, of, table_, is_word, known=known, log=log, sums=sums, row=row):
                order = np.argsort(keys)
                keys, of = keys[order], of[order]
                at, hit = _find(table_["k"], keys)
                at, of_hit = at[hit], of[hit]
                sums += np.bincount(of_hit, weights=table_["w"][at], minlength=len(sums))
                if is_word:
                    known += np.bincount(of_hit, minlength=len(known))
                    log += np.bincount(of_hit, weights=np.log10(table_["n"][at] + 1.0), minlength=len(log))
                cold = np.zeros(int((~hit).sum()), LOOKUP)
                cold["k"], cold["row"] = keys[~hit], of[~hit] + row
                return cold

            if total:
                found.append(look(h[here], text, hot_words, True))
                for level in range(1, depth + 1):  # a context stays below a retained one only
                    context, entry, _ = keys_at(h, here, level)
                    some = _in(bits, context)
                    here, text, entry = here[some], text[some], entry[some]
                    found.append(look(context[some], text, hot, False))
                    some = _in(bits, entry)
                    found.append(look(entry[some], text[some], hot, False))
            m = batch.num_rows
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([task % parts] * m, pa.int32()), "task": pa.array([task] * m, pa.int32()), "row": pa.array(np.arange(row, row + m), pa.int64()), "doc_id": batch.column("doc_id"), "held_out": pa.array([is_held_out(i, held) for i in ids], pa.bool_()),
                "n_tokens": pa.array(n, pa.int64()), "known": pa.array(known, pa.int64()), "log": pa.array(log, pa.float64()), "score": pa.array(sums, pa.float64()), "blob": pa.nulls(m, pa.binary()),
            })
            row += m
            if sum(map(len, found)) > FLUSH:
                yield from out()
        if sum(map(len, found)):
            yield from out()

    ids = docs.schema["doc_id"].dataType.simpleString()
    head = f"task int, row long, doc_id {ids}, held_out boolean, n_tokens long, known long, log double, score double, blob binary"
    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each task's positions, sums for its rows; the rows themselves pass."""
        t = _array(right, WEIGHT)
        t, made = t[np.argsort(t["k"])], []
        left = left.drop_columns(["part"])
        asked = left.filter(pc.is_valid(left.column("blob")))
        for task, blob in zip(asked.column("task").to_pylist(), asked.column("blob").to_pylist(), strict=True):
            keys, row = unpacked(blob)
            at, hit = _find(t["k"], keys)
            if not hit.any():
                continue
            at, (rows, of) = at[hit], np.unique(row[hit], return_inverse=True)
            s = np.zeros(len(rows), SUMS)
            n = t["n"][at]  # 0 for contexts and entries
            s["row"], s["score"], s["known"], s["log"] = rows, np.bincount(of, weights=t["w"][at]), np.bincount(of, weights=n > 0), np.bincount(of, weights=np.log10(n + 1.0))
            made.append((task, s.tobytes()))
        sums = pa.table({f.name: pa.array([m[0] for m in made], pa.int32()) if f.name == "task" else pa.array([m[1] for m in made], f.type) if f.name == "blob" else pa.nulls(len(made), f.type) for f in left.schema}, schema=left.schema)
        return pa.concat_tables([left.filter(pc.is_null(left.column("blob"))), sums])

    everything = _weights(tree.words, True).unionByName(_weights(tree.terms, False))
    def final(t: pa.Table) -> pa.Table:
        left, right = (t.filter(f(t.column("blob"))) for f in (pc.is_null, pc.is_valid))
        row = left.column("row").to_numpy()
        order = np.argsort(row)
        s = _array(right, SUMS)
        at = order[np.searchsorted(row[order], s["row"])]
        add = lambda c: np.bincount(at, weights=s[c], minlength=len(row))
        n = left.column("n_tokens").to_numpy()
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": left.column("n_tokens"), "n_known": pa.array(left.column("known").to_numpy() + add("known").astype(np.int64), pa.int64()), "train_tokens": pa.array(np.full(len(row), total), pa.int64()),
            "base_score": pa.array(left.column("log").to_numpy() + add("log") - n * np.log10(total + tree_kinds + 1), pa.float64()), "score": pa.array(left.column("score").to_numpy() + add("score"), pa.float64()),
        })

    tree_kinds = tree.kinds

    def scored(wave: int) -> DataFrame:
        each = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(WAVES)) == wave).mapInArrow(positions, f"part int, {head}")
        sums = meet(each, everything, look_up, head)
        return sums.groupBy("task").applyInArrow(final, f"doc_id {ids}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    # Each round's look-ups are deleted when its scores are written; those of the last one stay until the result is.
    return reduce(DataFrame.unionByName, [*(keep(scored(wave), f"lm-scores-{wave}") for wave in range(WAVES - 1)), scored(WAVES - 1)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
