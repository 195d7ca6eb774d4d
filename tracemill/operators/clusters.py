"""Average-linkage clustering of a sparse similarity table, by rounds of mutual nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialised
from .ranges import numbered

#: Similarities are held as whole numbers of this unit, so that sums are exact and equal means compare equal.
UNIT = 1_000_000_000
#: Pairs and clusters of a connected part that one task finishes; larger parts go on by rounds until they are as small.
LOCAL_PAIRS, LOCAL_CLUSTERS = 2_000_000, 2_000
#: Up to so many labels, what there is once for each label (a number, a size) is broadcast; beyond, it is joined.
FEW_LABELS = 1_000_000
#: Share of the clusters of large parts after whose merging all rows are written again.
REWRITE = 0.15
#: Requests of more components are joined with themselves, so that one of them is not expanded by one task.
WIDE = 1_000
_MERGE = "a long, b long, distance double, size long, round int"
#: A cluster and its neighbours: their numbers (int) and its sums of similarity to them (long) as bytes, the nearest one, and the size of both.
_ROW = "id long, size long, k long, to binary, s binary, best long, mean double, both long, open boolean"


def parts_of(ids: DataFrame, pairs: DataFrame, few=lambda df: df) -> DataFrame:
    """(id, part): the least id that pairs (a, b) lead to. Each round an id goes to the least of its neighbours, and on to where that one goes; then pairs are those of the places reached, and those within one are gone."""
    parts, edges, own = materialised(ids.select("id", F.col("id").alias("part")), "cluster-parts"), pairs.select("a", "b"), None
    while True:
        up = materialised(edges.select(F.explode(F.array("a", "b")).alias("id"), F.least("a", "b").alias("to")).groupBy("id").agg(F.min("to").alias("to")), "cluster-least")
        while True:
            on = materialised(up.join(few(up.select(F.col("id").alias("to"), F.col("to").alias("next"))), "to").select("id", "to", "next"), "cluster-least")
            discard(up)
            up = on.select("id", F.col("next").alias("to"))
            up.written_to = on.written_to
            if on.where("next < to").isEmpty():
                break
        to = lambda c: few(up.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")))
        after = materialised(parts.join(to("part"), "part", "left").select("id", F.coalesce("part_to", "part").alias("part")), "cluster-parts")
        left = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        left = materialised(left.distinct(), "cluster-near")
        discard(parts, up, *([own] if own else []))
        parts, edges, own = after, left, left
        if edges.isEmpty():
            discard(left)
            return parts


def merged_here(pairs: pd.DataFrame, first: int) -> pd.DataFrame:
    """All merges of a part's pairs (a, b, s, na, nb), in the rounds of ``average_linkage`` from round ``first`` on, over a matrix of sums."""
    ids = np.unique(np.concatenate([pairs["a"], pairs["b"]]))
    a, b = np.searchsorted(ids, pairs["a"]), np.searchsorted(ids, pairs["b"])
    sums, size = np.zeros((len(ids), len(ids)), np.int64), np.zeros(len(ids), np.int64)
    sums[a, b] = sums[b, a] = pairs["s"]
    size[a], size[b] = pairs["na"], pairs["nb"]
    out = []
    while len(ids) > 1 and sums.any():
        mean = sums / (size[:, None] * size)
        best = mean.argmax(1)  # of equal ones the least id, whose pair is the least, too
        here = np.arange(len(ids))
        a = np.flatnonzero((best[best] == here) & (here < best) & (mean[here, best] > 0))
        b = best[a]
        out.append(pd.DataFrame({"a": ids[a], "b": ids[b], "distance": 1 - mean[a, b] / UNIT, "size": size[a] + size[b], "round": np.full(len(a), first + len(out), np.int32)}))
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        size[a] += size[b]
        stay = np.setdiff1d(here, b)
        ids, size, sums = ids[stay], size[stay], sums[np.ix_(stay, stay)]
        np.fill_diagonal(sums, 0)
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": [], "size": [], "round": []})


def entries(batches: Iterator[pa.RecordBatch], least: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, to, s) of rows that hold one neighbour, or many as bytes, at least so many at a time; what one id has in rows that follow each other stays together."""
    held, n = [], 0
    for batch in batches:
        ids, to, s = (batch.column(c) for c in ("id", "to", "s"))
        ids = ids.to_numpy()
        if pa.types.is_binary(to.type):
            ends = np.frombuffer(to.buffers()[1], np.int32)[to.offset : to.offset + len(to) + 1]
            lie = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1]
            ids = np.repeat(ids, np.diff(ends) // 4)
            to, s = np.frombuffer(to.buffers()[2], np.int32, len(ids), ends[0]), np.frombuffer(s.buffers()[2], np.int64, len(ids), lie[0])
        else:
            to, s = to.to_numpy(), s.to_numpy()
        held.append((ids, to, s))
        n += len(ids)
        if n >= least:
            ids, to, s = (np.concatenate(x) for x in zip(*held))
            other = np.flatnonzero(ids != ids[-1])
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield ids[:cut], to[:cut], s[:cut]
            held, n = [(ids[cut:], to[cut:], s[cut:])], len(ids) - cut
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def gathered(was: np.ndarray, to: np.ndarray, s: np.ndarray, now: np.ndarray, size: np.ndarray, moved: np.ndarray, whole: bool = True) -> pa.RecordBatch:
    """Clusters' rows under the names that ``now`` gives, their sums to the same neighbour added up, and the nearest one. ``open``: the row is one of several that have become one cluster. Without ``whole`` only these hold their neighbours."""
    ids, to = now[was], now[to]
    keep = to != ids
    was, ids, to, s = was[keep], ids[keep], to[keep], s[keep]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    row = np.cumsum(first) - 1
    order = np.argsort(row * len(now) + to, kind="stable")  # rows stay where they are
    to, s = to[order], s[order]
    new = first.copy()
    new[1:] |= to[1:] != to[:-1]
    at = np.flatnonzero(new)
    row, ids, was, to, s = row[at], ids[at], was[at], to[at], np.add.reduceat(s, at) if len(at) else s
    mean = s / (size[ids] * size[to])
    start = np.flatnonzero(first[at])
    ends = np.r_[start, len(row)]
    top = np.repeat(np.maximum.reduceat(mean, start), np.diff(ends)) if len(start) else mean
    hit = np.flatnonzero(mean == top)
    near = hit[np.searchsorted(row[hit], row[start])]  # of equal ones the least id, whose pair is the least, too
    ids, best, opened, k = ids[start], to[near], moved[was[start]], np.diff(ends)
    if not whole:
        of, ends = np.repeat(opened, k), np.r_[0, np.cumsum(np.where(opened, k, 0))]
        to, s = to[of], s[of]
    held = lambda x: pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    return pa.RecordBatch.from_pydict({"id": ids.astype(np.int64), "size": size[ids], "k": k, "to": held(to), "s": held(s), "best": best.astype(np.int64), "mean": mean[near], "both": size[ids] + size[best], "open": opened})


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, s) of clusters' rows, each pair once."""
    for ids, to, s in entries(batches):
        for x in range(0, len(ids), 1 << 20):
            a, b, c = (y[x : x + (1 << 20)] for y in (ids, to, s))
            once = a < b
            yield pa.RecordBatch.from_pydict({"a": a[once], "b": b[once].astype(np.int64), "s": c[once]})


def _small(many: DataFrame) -> DataFrame:
    return many.where((F.col("pairs") <= LOCAL_PAIRS) & (F.col("clusters") <= LOCAL_CLUSTERS)).select("part")


def _finished(sized: DataFrame, k: int) -> DataFrame:
    return materialised(sized.select("part", "a", "b", "s", "na", "nb").groupBy("part").applyInPandas(lambda pdf: merged_here(pdf, k), _MERGE), "cluster-merges")


def _by_rows(pairs: DataFrame, part: DataFrame, n: int) -> list[DataFrame]:
    """The rounds of large parts, a cluster's neighbours in one row. A round reads the rows under their new names and writes what each one's nearest is; only rows of clusters that merge are shuffled and
    written anew. All rows are written again when ``REWRITE`` of the clusters have merged. Names and sizes of the n labels are broadcast."""
    spark, rounds, k = pairs.sparkSession, [], 0
    now, size, none = np.arange(n, dtype=np.int32), np.ones(n, np.int64), np.zeros(n, bool)
    since = np.full(n, -1, np.int32)  # the round in which a cluster last merged: rows written before (``at``) are no longer its own

    def renamed(rows, moved=none, whole=True, by=None):
        held = spark.sparkContext.broadcast((now, size, moved, since))

        def run(batches):
            now, size, moved, since = held.value
            own = (x.filter(pa.array(since[x.column("id").to_numpy()] <= x.column("at").to_numpy())) for x in batches)
            return (gathered(*x, now, size, moved, whole) for x in entries(own))

        out = materialised(rows.mapInArrow(run, _ROW), "cluster-rows", by)
        held.destroy()
        return out

    together = lambda rows: rows.repartition("id").sortWithinPartitions("id")
    written = lambda rows, at: rows.select("id", "to", "s", F.lit(at).alias("at"))
    ends = lambda a, b: pairs.select(F.col(a).alias("id"), F.col(b).cast("int").alias("to"), "s")
    rows = renamed(together(written(ends("a", "b").unionByName(ends("b", "a")), -1)))
    tables, nearest, whole = [rows], [], True
    while True:
        if whole:
            many = rows.join(F.broadcast(part), "id").groupBy("part").agg((F.sum("k") / 2).alias("pairs"), F.count("*").alias("clusters"))
            small = materialised(_small(many), "cluster-small")
            tables.append(small)
            if not small.isEmpty():
                inside = F.broadcast(part.join(small, "part"))
                flat = rows.join(inside, "id", "left_semi").select("id", "to", "s").mapInArrow(unpacked, "a long, b long, s long").join(inside.withColumnRenamed("id", "a"), "a")
                sizes = lambda c: F.broadcast(rows.select(F.col("id").alias(c), F.col("size").alias(f"n{c}")))
                rounds.append(_finished(flat.join(sizes("a"), "a").join(sizes("b"), "b"), k))
                rows = rows.join(inside, "id", "left_anti")
            left = seen = rows.count()
            held = [written(rows, k - 1)]
        near = rows.groupBy(F.least("id", "best").alias("a"), F.greatest("id", "best").alias("b")).agg(F.count("*").alias("c"), F.max("mean").alias("mean"), F.max("both").alias("size")).where("c = 2")
        merged = materialised(near.select("a", "b", (1 - F.col("mean") / UNIT).alias("distance"), "size", F.lit(k).alias("round")), "cluster-merges")
        a, b, grown = (x.to_numpy() for x in merged.select("a", "b", "size").toArrow().columns)
        if not len(a):  # while there are rows, two of them are nearest to each other
            discard(merged, *tables, *nearest)
            return rounds
        rounds.append(merged)
        step, moved = np.arange(n, dtype=np.int32), none.copy()
        step[b], size[a], moved[a], moved[b] = a, grown, True, True
        now, left = step[now], left - len(a)
        whole = left <= (1 - REWRITE) * seen or len(held) >= 32
        told = renamed(reduce(DataFrame.unionByName, held), moved, whole, "open")
        since[moved] = k
        again = renamed(together(written(told.where("open"), k)))
        discard(*nearest, *(tables if whole else []))
        rows, nearest, tables = told.where("not open").unionByName(again), [] if whole else [told], [told, again] if whole else [*tables, again]
        held, k = [*held, written(again, k)], k + 1


def _by_joins(pairs: DataFrame, part: DataFrame) -> list[DataFrame]:
    """The rounds of large parts as joins over all their pairs, for any number of labels."""
    sizes, rounds, k = materialised(part.select("id", F.lit(1).cast("long").alias("size")), "cluster-sizes"), [], 0
    pairs = materialised(pairs, "cluster-pairs")
    while not pairs.isEmpty():
        # Pairs of small parts leave for a task of their own; what is left of the others goes through a round of joins.
        placed = pairs.join(part.withColumnRenamed("id", "a"), "a")
        many = placed.groupBy("part").agg(F.count("*").alias("pairs")).join(part.join(sizes, "id").groupBy("part").agg(F.count("*").alias("clusters")), "part")
        small = materialised(_small(many), "cluster-small")
        if not small.isEmpty():
            rounds.append(_finished(placed.join(small, "part").join(sizes.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b"), k))
            rest = materialised(placed.join(small, "part", "left_anti").select("a", "b", "s"), "cluster-pairs")
            discard(pairs)
            pairs = rest
        discard(small)
        if pairs.isEmpty():
            break
        sized = pairs.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b")
        sized = sized.withColumn("mean", F.col("s") / (F.col("na") * F.col("nb")))
        rank = F.struct("mean", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), "na", "nb")
        best = sized.select(F.explode(F.array("a", "b")).alias("id"), rank.alias("r")).groupBy("id").agg(F.max("r").alias("r"))
        mutual = best.groupBy(F.col("r.a").alias("a"), F.col("r.b").alias("b")).agg(F.count("*").alias("c"), F.max("r").alias("r")).where("c = 2")
        merged = materialised(mutual.select((-F.col("a")).alias("a"), (-F.col("b")).alias("b"), (1 - F.col("r.mean") / UNIT).alias("distance"), (F.col("r.na") + F.col("r.nb")).alias("size"), F.lit(k).alias("round")), "cluster-merges")
        rounds.append(merged)
        to = merged.select(F.col("b").alias("was"), F.col("a").alias("now"))
        new = lambda c: F.coalesce(F.col(f"{c}_now"), F.col(c))
        moved = pairs.join(to.withColumnsRenamed({"was": "a", "now": "a_now"}), "a", "left").join(to.withColumnsRenamed({"was": "b", "now": "b_now"}), "b", "left").select(new("a").alias("x"), new("b").alias("y"), "s").where("x <> y")
        after = materialised(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")), "cluster-pairs")
        kept = materialised(_left(sizes, merged), "cluster-sizes")
        discard(pairs, sizes)
        pairs, sizes, k = after, kept, k + 1
    discard(pairs, sizes)
    return rounds


def _left(sizes: DataFrame, merged: DataFrame) -> DataFrame:
    """The clusters (id, size) that are left after merges."""
    grown = merged.groupBy(F.col("a").alias("id")).agg(F.max("size").alias("grown"))
    return sizes.join(merged.select(F.col("b").alias("id")), "id", "left_anti").join(grown, "id", "left").select("id", F.coalesce("grown", "size").alias("size"))


def _places(names: DataFrame) -> tuple[DataFrame, int]:
    """(name, id) of the distinct names in order, and how many there are. Ranges number them without holding them in one task."""
    names = materialised(names.select("name").distinct(), "cluster-names")
    ids = materialised(numbered(names.withColumn("_g", F.lit(0)), ["_g"], ["name"], "place", label="cluster-ids").select("name", (F.col("place") - 1).alias("id")), "cluster-ids")
    return ids, names.count()


def _few(n: int):
    """What marks a table of at most n rows as one to broadcast, if that is few."""
    return F.broadcast if n <= FEW_LABELS else lambda df: df


def average_linkage(labels: DataFrame, similarities: DataFrame) -> DataFrame:
    """(step, a, b, distance, size): the merges of a dendrogram, nearest first. Clusters 0 … n - 1 are the ``labels`` (name) in order, cluster n + i is made by step i; a < b.

    ``similarities``: component, other, jaccard of pairs that have any; the distance is 1 less it, of other pairs 1. The distance of clusters is the mean over the pairs of their members.
    Of equally near pairs the one goes first whose clusters have the lesser least members.

    Sums of similarity between clusters stay as sparse as the pairs are. A round merges every pair of clusters of which each is the other's nearest: with this linkage a merged cluster is no nearer to a third one
    than the nearer part was, so that these pairs are merges of the one-by-one order, too, ties included. What has nothing in common at the end is merged at distance 1, in the order of least members.

    Connected parts of the pairs have nothing to do with each other. A part of at most ``LOCAL_CLUSTERS`` clusters and ``LOCAL_PAIRS`` pairs is finished by one task, by the same rounds; larger ones are merged over all tasks until they are as small.
    """
    ids, n = _places(labels)
    few = _few(n)
    side = lambda c, to: few(ids.select(F.col("name").alias(c), F.col("id").alias(to)))
    pairs = similarities.join(side("component", "x"), "component").join(side("other", "y"), "other").where("x <> y")
    pairs = materialised(pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.round(F.col("jaccard") * UNIT).cast("long")).alias("s")).where("s > 0"), "cluster-pairs")
    return _linkage(ids, n, pairs)


def request_linkage(pairs: DataFrame) -> DataFrame:
    """``average_linkage`` of the components of ``pairs`` (request_id, component) by the requests they are in (``graph.cooccurrence``). Components are numbered first, and a request's are one row, so that only numbers met in one are shuffled."""
    ids, n = _places(pairs.select(F.col("component").alias("name")))
    few = _few(n)
    mine = pairs.join(few(ids.withColumnRenamed("name", "component")), "component")
    listed = materialised(mine.groupBy("request_id").agg(F.sort_array(F.collect_set("id")).alias("all")).withColumn("many", F.size("all")), "cluster-requests")
    sizes = materialised(listed.select(F.explode("all").alias("id")).groupBy("id").agg(F.count("*").alias("n")), "cluster-requests-of")
    known = listed.where("request_id is not null")
    both = known.where(F.col("many").between(2, WIDE)).select("all", "many", F.posexplode("all").alias("k", "a")).select("a", F.explode(F.expr("slice(all, k + 2, many)")).alias("b"))
    if not known.where(F.col("many") > WIDE).isEmpty():
        wide = known.where(F.col("many") > WIDE).select("request_id", F.explode("all").alias("a"))
        both = both.unionByName(wide.join(wide.withColumnRenamed("a", "b"), "request_id").where("a < b").select("a", "b"))
    of = lambda c: few(sizes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}")))
    jaccard = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    found = both.groupBy("a", "b").agg(F.count("*").alias("common")).join(of("a"), "a").join(of("b"), "b").select("a", "b", F.round(jaccard * UNIT).cast("long").alias("s"))
    found = materialised(found.where("s > 0"), "cluster-pairs")
    discard(listed, sizes)
    return _linkage(ids, n, found)


def _linkage(ids: DataFrame, n: int, pairs: DataFrame) -> DataFrame:
    few = _few(n)
    part = parts_of(ids.select("id"), pairs, few)
    placed = pairs.join(few(part.withColumnRenamed("id", "a")), "a")
    many = materialised(placed.groupBy("part").agg(F.count("*").alias("pairs")).join(part.groupBy("part").agg(F.count("*").alias("clusters")), "part"), "cluster-many")
    small = materialised(_small(many), "cluster-small")
    rounds = []
    if not small.isEmpty():
        rounds.append(_finished(placed.join(few(small), "part").withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")}), 0))
    large = many.join(small, "part", "left_anti").select("part")
    if not large.isEmpty():
        rest, inside = placed.join(few(large), "part").select("a", "b", "s"), materialised(part.join(few(large), "part").select("id", "part"), "cluster-parts")
        rounds += _by_rows(rest, inside, n) if n <= FEW_LABELS else _by_joins(rest, inside)
        discard(inside)
    discard(pairs, part, many, small)
    ones = ids.select("id", F.lit(1).cast("long").alias("size"))
    merged = materialised(reduce(DataFrame.unionByName, rounds), "cluster-merged") if rounds else None
    sizes, last = (materialised(_left(ones, merged), "cluster-sizes"), merged.agg(F.max("round")).first()[0] + 1) if rounds else (ones, 0)
    # Clusters without anything in common: each joins the first one.
    apart = materialised(numbered(sizes.withColumn("_g", F.lit(0)), ["_g"], ["id"], "place", {"upto": "size"}, "cluster-rest"), "cluster-rest")
    low = sizes.agg(F.min("id").alias("a"))
    out = apart.where("place > 1").join(F.broadcast(low)).select("a", F.col("id").alias("b"), F.lit(1.0).alias("distance"), F.col("upto").alias("size"), (F.lit(last) + F.col("place")).alias("round"))
    if rounds:
        out = out.unionByName(merged.withColumn("round", F.col("round").cast("long")))
    steps = numbered(out.withColumn("_g", F.lit(0)), ["_g"], ["distance", "round", "a", "b"], "place", label="cluster-steps").select((F.col("place") - 1).alias("step"), "a", "b", "distance", "size")
    steps = materialised(steps, "cluster-steps")
    # A cluster is named by its least member; its number is the last step before that made one of this name.
    uses = steps.select("step", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("id")))).alias("x")).select("step", "x.*")
    before = F.lag("step").over(Window.partitionBy("id").orderBy("step"))
    number = uses.withColumn("number", F.coalesce(before + n, "id")).groupBy("step").agg(F.min("number").alias("x"), F.max("number").alias("y"))
    return steps.join(number, "step").select("step", F.col("x").alias("a"), F.col("y").alias("b"), "distance", "size")
