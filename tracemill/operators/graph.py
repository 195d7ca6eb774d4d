"""Graph operators over edge tables (src, dst, …). Iterations cut their lineage with tables written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialised


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 40) -> DataFrame:
    """(id, rank): dangling mass is spread evenly, ranks are divided by the largest. Edges of kind ``contains`` don't count.

    What a step spreads evenly is one number b_k for all nodes, so the rank after k steps is the sum over j of damping^j u_j b_(k-j), where u_j is what 1 at every node becomes after j moves along the
    links. The u_j hold only nodes that end a walk of j links: in a graph without cycles they run out after its longest path, whatever the number of iterations. With
    the sums of the u_j over dangling nodes the b_k follow one from another, one number for each iteration.
    """
    if "kind" in edges.columns:
        edges = edges.where("kind <> 'contains'")
    nodes, edges = materialised(nodes.select("id"), "nodes"), materialised(edges.select("src", "dst"), "edges")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out_degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    base = materialised(nodes.join(out_degree, "id", "left").select("id", "degree"), "degrees")
    # Files are smaller than their rows: without the hints Spark takes up to a million nodes for small enough to broadcast.
    links = materialised(edges.join(base.withColumnRenamed("id", "src").hint("merge"), "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")), "links")
    discard(edges)
    lost = lambda df: df.where("degree is null").agg(F.coalesce(F.sum("u"), F.lit(0.0))).first()[0]
    walks, dangling, moved = [base.select("id", F.lit(1.0).alias("u"))], [lost(base.withColumn("u", F.lit(1.0)))], links.select("dst", F.col("share").alias("u"))
    for _ in range(iterations):
        flow = moved.groupBy(F.col("dst").alias("id")).agg(F.sum("u").alias("u"))
        walk = materialised(base.hint("merge").join(flow, "id").select("id", "degree", "u"), "walks")
        walks.append(walk.select("id", "u"))
        dangling.append(lost(walk))
        front = walk.where("degree is not null").select(F.col("id").alias("src"), "u")
        if front.isEmpty():
            break
        moved = links.join(front.hint("merge"), "src").select("dst", (F.col("u") * F.col("share")).alias("u"))
    even = [1.0 / n]
    for k in range(iterations):
        even.append((1 - damping + damping * sum(damping**j * x * even[k - j] for j, x in enumerate(dangling[: k + 1]))) / n)
    terms = [df.select("id", (F.col("u") * (damping**j * even[iterations - j])).alias("rank")) for j, df in enumerate(walks)]
    ranks = materialised(reduce(DataFrame.unionAll, terms).groupBy("id").agg(F.sum("rank").alias("rank")), "ranks")
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top)).select("id", (F.col("rank") / F.col("top")).alias("rank"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 20, hops: int = 2) -> DataFrame:
    """Rank around each seed (seed, id, rank) within so many hops; the walk restarts at its seed."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near = seeds.select("seed", F.col("seed").alias("id"))
    for _ in range(hops):
        near = near.union(near.join(both, near["id"] == both["src"]).select("seed", F.col("dst").alias("id"))).distinct()
    near = materialised(near, "near")
    local = near.withColumnRenamed("id", "src").join(both, "src").join(near.withColumnRenamed("id", "dst"), ["seed", "dst"]).select("seed", "src", "dst")
    degree = local.groupBy("seed", "src").agg(F.count("*").alias("degree"))
    local = materialised(local.join(degree, ["seed", "src"]).select("seed", "src", "dst", (1.0 / F.col("degree")).alias("share")), "local")
    ranks = near.select("seed", "id", (F.col("seed") == F.col("id")).cast("double").alias("rank"))
    for k in range(iterations):
        flow = local.join(ranks.withColumnRenamed("id", "src"), ["seed", "src"]).groupBy("seed", F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        restart = F.when(F.col("seed") == F.col("id"), 1 - damping).otherwise(0.0)
        ranks = near.join(flow, ["seed", "id"], "left").select("seed", "id", (restart + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if (k + 1) % 10 == 0:
            ranks = materialised(ranks, "ranks")
    return ranks


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = 6, reverse: bool = False) -> DataFrame:
    """(seed, id, depth) of everything within ``depth`` steps, each once at its least depth; without a depth, everything."""
    step = edges.select(F.col("dst" if reverse else "src").alias("id"), F.col("src" if reverse else "dst").alias("to")).distinct()
    seen = front = materialised(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")), "reached")
    k = 0
    while depth is None or k < depth:
        k += 1
        fresh = front.join(step, "id").select("seed", F.col("to").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(k))
        front = materialised(fresh, "reached")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("depth > 0")


def blast_radius(edges: DataFrame, component: str, depth: int = 6) -> DataFrame:
    """Everything up- and downstream of a component with its distance."""
    seed = edges.sparkSession.createDataFrame([(component,)], "seed string")
    up, down = reachable(edges, seed, depth, reverse=True), reachable(edges, seed, depth)
    return up.select(F.lit("up").alias("direction"), "id", "depth").union(down.select(F.lit("down").alias("direction"), "id", "depth"))


def backward_slices(calls: DataFrame, component: str, requests: int = 12) -> DataFrame:
    """From the component's failed (else deepest) call in each request to the root: the first call of the parent's name one level up."""
    mine = calls.where(F.col("component") == component)
    order = [F.desc((F.col("status") == "error").cast("int")), F.desc("depth"), F.asc("seq")]
    start = mine.withColumn("_k", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).where("_k = 1").orderBy("request_id").limit(requests)
    start = start.select("request_id", "parent_component", "depth", F.array("component").alias("path"))
    done, deepest = None, calls.agg(F.max("depth")).first()[0] or 0
    first = calls.groupBy("request_id", "component", "depth").agg(F.min_by("parent_component", "seq").alias("_up"))
    for _ in range(deepest + 1):
        ended = start.where((F.col("depth") == 0) | F.col("parent_component").isNull()).select("request_id", "path")
        done = ended if done is None else done.union(ended)
        going = start.where((F.col("depth") > 0) & F.col("parent_component").isNotNull())
        up = first.select("request_id", F.col("component").alias("parent_component"), (F.col("depth") + 1).alias("depth"), "_up")
        start = going.join(up, ["request_id", "parent_component", "depth"], "left").select("request_id", F.col("_up").alias("parent_component"), (F.col("depth") - 1).alias("depth"), F.concat(F.array("parent_component"), "path").alias("path"))
    return done.union(start.select("request_id", "path"))


def adjacent(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One step in either direction."""
    out = edges.join(seeds.withColumnRenamed("seed", "src"), "src").select(F.col("dst").alias("id"))
    return out.union(edges.join(seeds.withColumnRenamed("seed", "dst"), "dst").select(F.col("src").alias("id"))).distinct()


def flow_flags(flow: DataFrame, static: DataFrame) -> DataFrame:
    """Observed edges; ``observed_only`` where no static edge joins the two in either direction."""
    pair = lambda: (F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"))
    known = static.select(*pair()).distinct().withColumn("_known", F.lit(True))
    return flow.select("*", *pair()).join(known, ["_a", "_b"], "left").withColumn("observed_only", F.col("_known").isNull()).drop("_a", "_b", "_known")


def edge_diff(dynamic: DataFrame, static: DataFrame) -> DataFrame:
    """Edges seen only when running, only in the source, or in both."""
    kind = F.when(F.col("_s").isNull(), "dynamic").when(F.col("_d").isNull(), "static").otherwise("both")
    return dynamic.select("src", "dst", "weight", F.lit(1).alias("_d")).join(static.select("src", "dst").distinct().withColumn("_s", F.lit(1)), ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"), kind.alias("found"))


def file_level(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and rank by file, and the traffic between files."""
    files = nodes.groupBy("file").agg(F.count("*").alias("symbols"), F.sum("rank").alias("rank"))
    side = lambda name: nodes.select(F.col("id").alias(name), F.col("file").alias(f"{name}_file"))
    traffic = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count("*").alias("edges"))
    return files, traffic


def parents_and_siblings(nodes: DataFrame, edges: DataFrame, cap: int = 8) -> DataFrame:
    """(id, parent, sibling, place): what shares a container with each node, best ranks first."""
    inside = edges.where("kind = 'contains'").select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    both = inside.join(inside.withColumnRenamed("id", "sibling"), "parent").where("id <> sibling").join(nodes.select(F.col("id").alias("sibling"), "rank"), "sibling")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rank"), "sibling"))
    return both.withColumn("place", place).where(F.col("place") <= cap).select("id", "parent", "sibling", "place")


def name_specificity(nodes: DataFrame) -> DataFrame:
    """1 / how many nodes bear the name."""
    return nodes.join(nodes.groupBy("name").agg((1.0 / F.count("*")).alias("specificity")), "name").select("id", "specificity")


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """Jaccard similarity of components by the requests they are in. ``pairs``: distinct (request_id, component)."""
    size = pairs.groupBy("component").agg(F.count("*").alias("n"))
    both = pairs.join(pairs.withColumnRenamed("component", "other"), "request_id").where("component < other").groupBy("component", "other").agg(F.count("*").alias("common"))
    out = both.join(size, "component").join(size.select(F.col("component").alias("other"), F.col("n").alias("m")), "other")
    return out.select("component", "other", (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("jaccard"))


def resolve_suffix(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """Runtime components to nodes: equal last names and a module that ends the path; what fits several nodes fits none."""
    c = components.select("component", F.element_at(F.split("component", r"\."), -1).alias("name"), F.regexp_replace("component", r"\.[^.]*$", "").alias("_module"))
    fits = (F.col("module") == F.col("_module")) | F.concat(F.lit("."), "module").endswith(F.concat(F.lit("."), "_module")) | F.concat(F.lit("."), "_module").endswith(F.concat(F.lit("."), "module"))
    found = c.join(nodes.select("id", "name", "module"), "name").where(fits)
    return found.groupBy("component").agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1").select("component", "id")


def dead_code(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no root reaches."""
    live = reachable(edges, roots, None).select("id").union(roots.select(F.col("seed").alias("id"))).distinct()
    return nodes.join(live, "id", "left_anti")
