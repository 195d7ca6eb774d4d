"""Near-duplicate groups from bottom-k sketches of one hash function.

A text's set is its distinct 5-word shingles, hashed once. Texts with equal sets are one class from the start (by a fingerprint of
the set), so copies are never compared. Of each class the ``POOL`` smallest hashes are its sketch. Retained values are put into
inverted lists: the ``INDEX`` smallest that are not frequent, and for classes whose sketch is frequent to a large part the ``INDEX``
smallest altogether as well. Two sets with similarity 0.85 miss each other in all lists with a chance of 0.15 ** INDEX (1e-10), at
0.8 of 0.2 ** INDEX (4e-9).

Lists generate candidates in two rounds, so that no list is expanded into all its pairs:

1. every member with a few pivots of its list (smallest, largest and one in a hashed order);
2. only members that are not yet in the same component, with the list's other components: directly where at most ``FEW`` members are
   outside the largest component (so the pairs grow with the list's length), else only those that exact lower bounds of their
   distance leave open (see ``family_pairs``).

The sketch of the union of both sets filters candidates (a pair at the threshold fails with a chance of about 1e-10 or less at 0.85,
2e-08 at 0.8), and the full sets confirm each link. Components come from alternating large-star and small-star steps over written tables.

Defined results: null or empty texts have an empty set and stay alone; rows with the same doc_id are one document; a row without
doc_id is never linked to others by itself (its component is that of an equal set, else null) and is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, keep, slices, table

SHINGLE = 5
#: 100 * intersection >= percent * union: by the contract of the op9 query, and for stages, which have no contract of their own.
PERCENT, STAGE_PERCENT = 85, 80
POOL, INDEX = 64, 12
#: A value in more sketches than this is frequent; a sketch needs so many other values to do without its frequent ones: of POOL values
#: at most 15 % are expected to be missing in a similar set (20 % at 0.8), so that all of these are missing has a chance of 2e-09 (1e-06).
FREQUENT, ENOUGH = 64, 30
#: Members outside a list's largest component that are paired with the whole list; with more, bounds of the distance come first.
FEW = 16
#: Slots into which a family's members are sorted by how far they can reach.
SLOTS = 64
#: Least part of the union's sketch that both sets must hold to be compared in full.
LEAST_OVERLAP = 0.5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Shingle sets of texts; remembers the hashes of words."""

    def __init__(self, width: int = SHINGLE, remembered: int = 500_000):
        import xxhash

        self.width, self.remembered, self.known, self.hash = width, remembered, {}, xxhash.xxh3_64_intdigest

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes, order-preserving as signed integers."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > self.remembered:
            self.known.clear()
        known, h = self.known, self.hash
        w = np.array([known[x] if x in known else known.setdefault(x, h(x)) for x in words], np.uint64)
        k = min(self.width, len(w))
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out ^ w[i : len(w) - k + 1 + i])
        return np.unique((out ^ np.uint64(1 << 63)).view(np.int64))


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, mark (fingerprint of the set), pool (its smallest hashes)."""

    def run(batches):
        import xxhash

        hasher = Hasher(width)
        for batch in slices(batches):
            sets = [hasher.shingles(t) for t in as_bytes(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(map(len, sets), pa.int64()), "mark": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "pool": pa.array([s[:POOL] for s in sets], pa.list_(pa.int64()))})

    df = docs.select("doc_id", "text")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_shingles long, mark binary, pool array<bigint>")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(value, rep, n): rows of the lists that have two members or more."""
    each = reps.select("rep", "n", F.posexplode("pool").alias("pos", "value"))
    often = each.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    shared = each.join(often, "value").groupBy("rep", "n").agg(F.collect_list(F.struct("pos", "value", "c")).alias("x"))  # POOL of a class at most
    shared = shared.join(reps.select("rep", F.size("pool").alias("size")), "rep")
    frequent = lambda x: x["c"] > FREQUENT
    hot = F.filter("x", frequent)
    # A value's rank among the infrequent ones counts those in no other sketch, too: they have no row here.
    rare_rank = lambda x: x["pos"] - F.size(F.filter(hot, lambda y: y["pos"] < x["pos"]))
    rare = F.filter("x", lambda x: ~frequent(x) & (rare_rank(x) < INDEX))
    plain = F.when(F.col("size") - F.size(hot) < F.least(F.lit(ENOUGH), F.col("size")), F.filter("x", lambda x: x["pos"] < INDEX)).otherwise(F.filter("x", lambda x: F.lit(False)))
    rows = shared.select("rep", "n", F.explode(F.array_union(F.transform(rare, lambda x: x["value"]), F.transform(plain, lambda x: x["value"]))).alias("value"))
    return rows


def _pair(a: Column, b: Column, na: Column, nb: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.least(na, nb).alias("small"), F.greatest(na, nb).alias("large")]


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """The size bound: the intersection is the smaller set at most, the union the larger at least."""
    return pairs.where((F.col("a") != F.col("b")) & (100 * F.col("small") >= percent * F.col("large"))).select("a", "b").distinct()


def star_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    me = F.struct("rep", "n")
    pivots = lists.groupBy("value").agg(F.min(me).alias("p"), F.max(me).alias("q"), F.min_by(me, F.xxhash64("rep", F.pmod("value", F.lit(3)))).alias("r"))
    each = lists.join(pivots, "value").select("rep", "n", F.explode(F.array("p", "q", "r")).alias("p"))
    return _possible(each.select(*_pair(F.col("rep"), F.col("p.rep"), F.col("n"), F.col("p.n"))), percent)


def cross_pairs(lists: DataFrame, labels: DataFrame, docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs of one list that are in different components; what is in a list's largest component is not paired within it."""
    here = keep(lists.join(labels, "rep", "left").select("value", "rep", "n", F.coalesce("component", "rep").alias("component")), "list-components")
    parts = here.groupBy("value", "component").agg(F.count("*").alias("c"))
    main = parts.groupBy("value").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts"), (F.sum("c") - F.max("c")).alias("outside"))
    main = keep(main.where("parts > 1").select("value", "main", "outside"), "list-mains")
    rest = here.join(main.where(F.col("outside") <= FEW), "value").where(F.col("component") != F.col("main")).select("value", F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("component").alias("yc"), "main")
    both = rest.join(here, "value").where((F.col("component") != F.col("yc")) & ((F.col("component") == F.col("main")) | (F.col("rep") > F.col("y"))) & (100 * F.least("n", "yn") >= percent * F.greatest("n", "yn")))
    close = both.select(*_pair(F.col("rep"), F.col("y"), F.col("n"), F.col("yn")))
    members = keep(here.join(main.where(F.col("outside") > FEW), "value").select(F.col("main").alias("family"), "rep", "n", "component").distinct(), "families")
    return _possible(close if members.isEmpty() else close.unionByName(family_pairs(members, docs, width, **({} if percent == PERCENT else {"percent": percent}))), percent)


def family_pairs(members: DataFrame, docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs of a family's members in different components that the distances to one pivot leave open; no link is ruled out.

    ``members``: family (the component that is the largest in a list, and its smallest member, the pivot), rep, n, component. With u
    the values of a set that only its own component holds and x the distance of its other values from those of the pivot (values in
    just one of the two), sets A and B of different components differ in uA + uB + |xA - xB| values or more, and linked ones in
    (100 - percent) / (100 + percent) of nA + nB at most. So A needs a B with a large enough x - u: a set that the family's largest
    x - u does not reach is alone, and others meet only sets from that value on, by slots of x - u.
    """
    pivots = members.select(F.col("family").alias("rep"), F.col("family").alias("component"))
    ids = keep(members.select("rep", "component").union(pivots).distinct(), "family-members")
    held = keep(full_sets(docs, ids.select(F.col("rep").alias("doc_id")), width).join(ids, "rep"), "family-sets")
    values = held.select("rep", "component", F.explode("set").alias("value"))
    common = values.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("value")
    shared = keep(values.join(common, "value").groupBy("rep").agg(F.collect_set("value").alias("shared")), "shared-sets")  # a part of one text's set

    pivot = shared.select(F.col("rep").alias("family"), F.col("shared").alias("p"))
    both = members.join(shared, "rep").join(pivot, "family", "left").withColumn("p", F.coalesce("p", F.array().cast("array<bigint>")))
    x = F.size(F.array_except("shared", "p")) + F.size(F.array_except("p", "shared"))
    u = F.col("n") - F.size("shared")
    placed = keep(both.select("family", "rep", "n", "component", (u + x).alias("far"), (x - u).alias("slack")), "placed")

    least = F.floor(F.col("far") - (100 - percent) / (100 + percent) * (1 + 100 / percent) * F.col("n"))  # the slack that a partner must have
    placed = placed.withColumn("least", least)
    ends = placed.groupBy("family").agg(F.max("slack").alias("top"), F.min("least").alias("low"))
    step = F.greatest(F.lit(1), F.ceil((F.col("top") - F.col("low") + 1) / SLOTS))
    alive = placed.join(ends, "family").where("least <= top").withColumn("step", step)
    slot = lambda value: F.least(F.lit(SLOTS - 1), F.floor((F.col("top") - F.col(value)) / F.col("step"))).cast("int")
    seek = alive.where("component <> family").select("family", "rep", "n", "component", "far", "slack", F.explode(F.sequence(F.lit(0), slot("least"))).alias("slot"))
    find = alive.select("family", slot("slack").alias("slot"), *[F.col(c).alias(f"y_{c}") for c in ("rep", "n", "component", "far", "slack")])
    near = lambda far, slack: (100 + percent) * (F.col(far) - F.col(slack)) <= (100 - percent) * (F.col("n") + F.col("y_n"))
    open_ = (F.col("component") != F.col("y_component")) & ((F.col("y_component") == F.col("family")) | (F.col("rep") > F.col("y_rep"))) & near("far", "y_slack") & near("y_far", "slack")
    return seek.join(find, ["family", "slot"]).where(open_).select(*_pair(F.col("rep"), F.col("y_rep"), F.col("n"), F.col("y_n")))


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose union sketch holds enough values of both."""
    pool = lambda name: reps.select(F.col("rep").alias(name), F.col("pool").alias(f"p{name}"))
    both = pairs.join(pool("a"), "a").join(pool("b"), "b")
    union = F.slice(F.sort_array(F.array_union("pa", "pb")), 1, POOL)
    common = F.size(F.array_intersect(union, F.array_intersect("pa", "pb")))
    return both.where(common >= LEAST_OVERLAP * F.size(union)).select("a", "b")


def full_sets(docs: DataFrame, ids: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(rep, set) of the documents named by ``ids`` (doc_id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches):
        hasher = Hasher(width)
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"rep": batch.column("doc_id"), "set": pa.array([hasher.shingles(t) for t in as_bytes(batch)], pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(sets, f"rep {kind}, set array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "compared")
    found = keep(full_sets(docs, ids, width), "sets")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                both = len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                ok.append(100 * both >= percent * (len(x.values) + len(y.values) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda name: found.select(F.col("rep").alias(name), F.col("set").alias(f"s{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(rep, component) of every node with an edge; component is the smallest node reachable."""

    def are_stars(df: DataFrame) -> bool:
        """No node has two parents or is both child and parent, so that each component is one star."""
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(df.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where((F.col("child") > 1) | (F.col("child") + F.col("parent") > 1)).isEmpty()

    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most):
        if are_stars(now):
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = keep(large, "large-star")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = keep(small, "small-star")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "rep")
    return nodes.unionByName(nodes.select(F.col("component").alias("rep"), "component").distinct())


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    each = keep(sketches(docs, width), "sketches")
    classes = each.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("pool").alias("pool"))
    classes = keep(classes, "classes")
    reps = classes.select("rep", "n", "pool")
    lists = keep(inverted_lists(reps), "lists")
    first = keep(likely(star_pairs(lists, percent), reps), "pairs")
    linked = components(confirmed(first, docs, width, percent))
    labels = keep(linked, "components")
    second = keep(likely(cross_pairs(lists, labels, docs, width, percent).join(first, ["a", "b"], "left_anti"), reps), "more-pairs")
    if not second.isEmpty():
        more = confirmed(second, docs, width, percent)
        labels = keep(components(labels.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(more)), "components")
    final = classes.select("mark", "rep").join(labels, "rep", "left").select("mark", F.coalesce("component", "rep").alias("component"))
    final = keep(final, "class-components")
    discard(lists, first, second)
    some = F.col("n_shingles") > 0  # texts without words share a mark, so they stay out of the join
    out = each.where(some).select("doc_id", "n_shingles", "mark").join(final, "mark", "left").select("doc_id", "n_shingles", "component")
    out = out.unionByName(each.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.col("component")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, percent: int = STAGE_PERCENT) -> DataFrame:
    """One document of each group, with all its columns."""
    found = keep(near_duplicates(docs, percent=percent), "groups")
    gone = keep(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=PERCENT)


