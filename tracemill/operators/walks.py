"""Walks over code graphs: relevance to anchors by typed random walks, and call trees from roots."""

from __future__ import annotations

from math import ceil, log

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, materialised
from .graph import name_specificity
from .ranges import numbered

KINDS = ("invoke", "inherit", "contains", "flow")
#: Neighbours of one node that are joined by one key.
BLOCK = 50_000
#: Neighbours of all nodes that one task holds on disk for the steps.
PART = 2_000_000
#: With fewer for each of the usual partitions they are shuffled in each step, which then takes less than so many tasks.
LEAST_PART = 250_000


def anchor_weight(place: Column, k0: float = 60.0) -> Column:
    """The weight of the retrieval hit at ``place`` (from 0)."""
    return 1.0 / (place + k0 + 1.0)


def links(nodes: DataFrame, edges: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """(kind, src, dst, w), ``kind`` as its place in ``KINDS``; observed calls weigh log(1 + calls). Edges to the own node, to unknown ones or of unknown kinds drop out.

    What the edges name is first made distinct: as a rule no unknown node is among it, and then the edges themselves meet no table of nodes.
    """
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i).cast("byte")) for i, k in enumerate(KINDS[:3])])
    typed = edges.where(F.col("kind").isin(*KINDS[:3])).select(kind.alias("kind"), "src", "dst", F.lit(1.0).alias("w"))
    if flow is not None:
        typed = typed.unionByName(flow.select(F.lit(KINDS.index("flow")).cast("byte").alias("kind"), "src", "dst", F.log1p("calls").alias("w")))
    typed = typed.where("src <> dst")
    ends = typed.select("src").distinct().unionByName(typed.select(F.col("dst").alias("src")).distinct()).distinct()
    unknown = materialised(ends.join(nodes.select(F.col("id").alias("src")), "src", "left_anti"), "walk-unknown")
    if not unknown.isEmpty():
        typed = typed.join(unknown, "src", "left_anti").join(unknown.withColumnRenamed("src", "dst"), "dst", "left_anti").select("kind", "src", "dst", "w")
    near = materialised(typed, "walk-links")
    discard(unknown)
    return near


def both_ways(near: DataFrame) -> DataFrame:
    return near.unionByName(near.select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def context_walk(nodes: DataFrame, edges: DataFrame, flow: DataFrame | None, anchors: DataFrame, *, beta: dict[str, float], alpha: float = 0.25, tolerance: float = 1e-4, budget: int = 40, max_hops: int | None = None) -> DataFrame:
    """(id, mass, anchor, place): the ``budget`` nodes of the largest mass in a walk that restarts at the anchors; all anchors are in.

    ``nodes``: id, name. ``edges``: src, dst, kind (``contains``, ``invoke``, ``inherit``). ``flow``: src, dst, calls. ``anchors``: id, weight (times 1 / number of nodes of the
    name). A step takes kind t with share beta_t and then a neighbour by weight; the shares of kinds that a node lacks go back to the anchors. The mass that
    is not settled shrinks by 1 - ``alpha`` a step, so steps = log(tolerance) / log(1 - alpha). ``max_hops``: no node further from all anchors.

    A node's neighbours are dealt in blocks, so one node may have any share of the edges. The neighbours are dealt to tasks once and stay there on disk: a step only
    brings the masses to them, one row for each node, kind and block, which has the kind's share of the mass for each unit of weight. So neighbours need no join with their node's sums,
    and edges between the same nodes add up in the step. Each step's masses are written; the step before is then deleted.
    """
    nodes = nodes.select("id", "name")
    start = anchors.join(name_specificity(nodes), "id").groupBy("id").agg(F.sum(F.col("weight") * F.col("specificity")).alias("s"))
    start = start.join(F.broadcast(start.agg(F.sum("s").alias("all")))).where("all > 0").select("id", (F.col("s") / F.col("all")).alias("s"))
    start = materialised(start, "walk-anchors")
    total = sum(beta.get(k, 0.0) for k in KINDS)
    near = links(nodes, edges, flow)
    share = F.coalesce(*[F.when(F.col("kind") == i, F.lit(beta.get(k, 0.0) / total if total > 0 else 0.0)) for i, k in enumerate(KINDS)])
    degree = both_ways(near).groupBy("src", "kind").agg(F.sum("w").alias("degree"), F.count("*").alias("n")).where("degree > 0").withColumn("share", share)
    ways = F.collect_list(F.struct("kind", (F.col("share") / F.col("degree")).alias("unit")))  # one for each kind
    out = materialised(degree.groupBy("src").agg(F.sum("share").alias("out"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.sum("n").alias("n"), ways.alias("ways")), "walk-nodes")
    # The lists of a large node are cut by a hash of the neighbour, so is what they are joined with.
    large = F.broadcast(out.where("blocks > 1").select("src", "blocks"))  # fewer than edges / BLOCK
    some = both_ways(near).where((share > 0) & (F.col("w") != 0)).join(large, "src", "left")
    n, fewest = out.agg(F.sum("n")).first()[0] or 0, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, ceil(n / PART), fewest if n >= fewest * LEAST_PART else 0)  # with fewer than ``fewest`` Spark shuffles them again in each step
    block = F.pmod(F.xxhash64("dst"), F.coalesce("blocks", F.lit(1))).cast("int")
    steps = some.select("src", "kind", block.alias("block"), "dst", "w").repartition(parts, "src", "kind", "block").persist(StorageLevel.DISK_ONLY)
    steps.count()  # Spark takes over their partitions only when they are there
    mass = materialised(start.select("id", F.col("s").alias("mass")), "walk-mass")
    for _ in range(max(1, ceil(log(tolerance) / log(1 - alpha))) if total > 0 else 0):
        here = mass.join(out.withColumnRenamed("src", "id"), "id", "left")
        lost = here.agg(F.coalesce(F.sum(F.col("mass") * (1 - F.coalesce("out", F.lit(0.0)))), F.lit(0.0)).alias("lost"))
        sent = here.where("mass > 0").select(F.col("id").alias("src"), "blocks", "mass", F.explode("ways").alias("way")).select("src", F.col("way.kind").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), (F.col("mass") * F.col("way.unit")).alias("m"))
        moved = steps.join(sent.hint("shuffle_hash"), ["src", "kind", "block"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("m") * F.col("w")).alias("got"))
        both = moved.join(start, "id", "full").join(F.broadcast(lost))
        s = F.coalesce("s", F.lit(0.0))
        after = materialised(both.select("id", (alpha * s + (1 - alpha) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * s)).alias("mass")), "walk-mass")
        discard(mass)
        mass = after
    steps.unpersist()
    ranked = mass.join(start.select("id", F.lit(True).alias("anchor")), "id", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    if max_hops is not None:
        seen = front = start.select("id")
        pairs = both_ways(near).select(F.col("src").alias("id"), "dst").distinct()
        for _ in range(max_hops):
            front = materialised(front.join(pairs, "id").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "walk-front")
            seen = seen.unionByName(front)
        ranked = ranked.join(seen, "id", "semi")
    order = [F.desc("anchor"), F.desc("mass"), F.asc("id")]
    placed = numbered(ranked.where("anchor OR mass > 0").withColumn("_g", F.lit(0)), ["_g"], order, "place", label="walk-places")
    return placed.where(F.col("anchor") | (F.col("place") <= budget)).select("id", "mass", "anchor", "place")


def call_trees(edges: DataFrame, roots: DataFrame, max_depth: int = 12) -> DataFrame:
    """(root, path, depth, id, state): the calls below each root, every node once with its own calls.

    ``edges``: src, dst of resolved calls, dst null for a call that leads out. ``path``: ids from the root to the node. A node's calls are listed where it is first reached: at the least depth, there by
    the least path. State: ``expanded`` (its calls follow), ``leaf`` (it makes none), ``elsewhere`` (it stands at another place with its calls), ``truncated`` (at ``max_depth``), ``external``.

    One round for each level; as a node goes on once for each root, a level has no more rows than there are edges, and cycles end.
    """
    links = materialised(edges.select("src", "dst").distinct(), "tree-links")
    callers = links.select("src").distinct()
    seen = front = materialised(roots.select("root", F.col("root").alias("id")).distinct().select("root", "id", F.array("id").alias("path")), "tree-level")
    seen = seen.select("root", "id")
    out = [front.join(callers.withColumnRenamed("src", "id"), "id", "left_anti").select("root", "path", F.lit(0).alias("depth"), "id", F.lit("leaf").alias("state")), front.join(callers.withColumnRenamed("src", "id"), "id", "semi").select("root", "path", F.lit(0).alias("depth"), "id", F.lit("expanded").alias("state"))]
    for depth in range(1, max_depth + 2):
        made = front.join(links.withColumnRenamed("src", "id"), "id").select("root", "path", F.col("dst").alias("id"))
        known = made.where("id is not null").join(seen, ["root", "id"], "semi").select("root", "path", "id", F.lit("elsewhere").alias("state"))
        fresh = made.where("id is not null").join(seen, ["root", "id"], "left_anti")
        first = fresh.groupBy("root", "id").agg(F.min("path").alias("path")).withColumn("_first", F.lit(True))
        marked = fresh.join(first, ["root", "id", "path"], "left").join(callers.select(F.col("src").alias("id"), F.lit(True).alias("_calls")), "id", "left")
        if depth > max_depth:
            state = F.lit("truncated")
        else:
            state = F.when(F.col("_first").isNull(), "elsewhere").when(F.col("_calls").isNull(), "leaf").otherwise("expanded")
        level = known.unionByName(marked.select("root", "path", "id", state.alias("state"))).unionByName(made.where("id is null").select("root", "path", "id", F.lit("external").alias("state")))
        level = materialised(level.select("root", F.when(F.col("id").isNull(), F.col("path")).otherwise(F.concat("path", F.array("id"))).alias("path"), F.lit(depth).alias("depth"), "id", "state"), "tree-level")
        out.append(level)
        front = level.where("state = 'expanded'").select("root", "id", "path")
        if depth > max_depth or front.isEmpty():
            break
        seen = seen.unionByName(level.where("state IN ('expanded', 'leaf')").select("root", "id"))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def path_to(tree: DataFrame, target: DataFrame) -> DataFrame:
    """(root, id, path): of the paths to each node of ``target`` (id) the shortest, of these the least."""
    best = F.min(F.struct(F.size("path").alias("n"), F.col("path").alias("path")))
    return tree.where("id is not null").join(target.select("id").distinct(), "id").groupBy("root", "id").agg(best["path"].alias("path"))
