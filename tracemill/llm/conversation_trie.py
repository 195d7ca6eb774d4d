"""Prefix trie of conversations, built level by level.

At each depth the live conversations are grouped by (parent node, next turn); a group is a node, named by its least conversation id. A node whose
members are equal to their ends (a single one, or copies) is closed: what follows is one chain, written from the turns of its least
member. The others go on to the next depth, so there are as many rounds as the deepest place where two conversations part. Then the levels are rolled up from the
deepest to the root: leaves and saved tokens are summed over each node's children.

Texts are read once, for a turn's 128-bit digest and its words; turns with equal digests count as equal. Positions and running words come from sorted ranges, so one
conversation may hold any share of all turns; joins from turns to conversations go by blocks of ``BLOCK`` turns, and nodes with many members are sent to
the members' tasks instead of the other way around (``HOT`` of them at most). The ids of conversations that end at one node are hashed as a stream.

Defined results: turns are ordered by number (null first), then by digest; a null role or text counts as empty; repeated rows are turns of their own. Rows without a conversation id
belong to none and are left out. An empty table has no nodes. Other columns are not read. Long texts cost their digest only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .common import discard, keep, table

#: Turns of one conversation that are joined by one key.
BLOCK = 50_000
#: Nodes of a level that may be broadcast: those with more than 1 / HOT of its members (or FEW), which are HOT at most.
HOT, FEW = 2_000, 10_000
#: Ids in one chunk of a node's ends.
CHUNK = 8_192
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (digest of role and text), words, upto (words so far) of every turn of a conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    slim = keep(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), key.alias("key"), words_of(text).alias("words")), "trie-turns")
    out = numbered(slim, ["conv_id"], [F.asc_nulls_first("turn"), "key"], "pos", {"upto": "words"}, "trie-ranges").drop("turn")
    out = keep(out, "trie-positions")
    discard(slim)
    return out


def shared_heads(own: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % ``family``, then c's own turns after its first h; h = crc32(c) % ``heads``.

    conv_id, depth, key, words, upto as ``turns`` has them; and one row with depth 0 (key null, no words) for each conversation, even one without turns.
    """
    head = [F.sum(F.when(F.col("pos") <= k, F.col("words")).otherwise(0)).alias(f"w{k}") for k in range(1, heads)]
    sizes = keep(own.groupBy("conv_id").agg(F.max("pos").alias("n"), *head), "trie-sizes")
    first = lambda k, a="": F.coalesce(*[F.when(k == j, F.col(f"{a}w{j}")) for j in range(1, heads)], F.lit(0))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[F.col(f"w{j}").alias(f"base_w{j}") for j in range(1, heads)])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    c = sizes.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(base, "base", "left")
    c = c.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = keep(c.select("conv_id", "base", "n", "h", "m", first(F.col("h")).alias("skipped"), first(F.col("m"), "base_").alias("lead")), "trie-families")
    block = lambda x: F.floor((x - 1) / BLOCK)
    spread = convs.where("n > h").select("conv_id", "h", "m", "skipped", "lead", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("n")))).alias("block"))
    rest = own.withColumn("block", block(F.col("pos"))).join(spread, ["conv_id", "block"]).where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "key", "words", (F.col("upto") - F.col("skipped") + F.col("lead")).alias("upto"))
    # Each first turn goes to the conversations of one family at most.
    lent = own.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base").join(convs.where("m > 0").select("conv_id", "base", "m"), "base").where("pos <= m")
    lent = lent.select("conv_id", F.col("pos").alias("depth"), "key", "words", "upto")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("upto"))
    out = keep(rest.unionByName(lent).unionByName(roots), "trie-rebuilt")
    discard(sizes, convs)
    return out


def _with_nodes(members: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Members with their nodes; those of a node with very many members meet it by broadcast."""
    on, most = ["parent", "key"], max(FEW, total // HOT)
    cols = [c for c in nodes.columns if c not in on]
    hot = nodes.where(F.col("n_convs") > most).select(*on, F.struct(*cols).alias("hot"))
    seen = members.join(F.broadcast(hot), on, "left")
    shuffled = seen.where("hot is null").drop("hot").join(nodes.where(F.col("n_convs") <= most).select(*on, F.struct(*cols).alias("hot")), on)
    return seen.where("hot is not null").unionByName(shuffled)


def _ends(members: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of nodes at which conversations end. ``members``: depth, node, member."""

    def chunks(batches):
        run, ids = None, []
        for batch in batches:
            out = []
            for at, member in zip(zip(batch.column("depth").to_pylist(), batch.column("node").to_pylist(), strict=True), batch.column("member").to_pylist(), strict=True):
                if ids and (at != run or len(ids) == CHUNK):
                    out.append((*run, ids[0], ",".join(map(str, ids))))
                    ids = []
                run = at
                ids.append(member)
            if out:
                yield _batch(out, ("depth", "node", "first"), "ids")
        if ids:
            yield _batch([(*run, ids[0], ",".join(map(str, ids)))], ("depth", "node", "first"), "ids")

    def hashes(batches):
        run = digest = None
        for batch in batches:
            out = []
            for at, ids in zip(zip(batch.column("depth").to_pylist(), batch.column("node").to_pylist(), strict=True), batch.column("ids").to_pylist(), strict=True):
                if at != run:
                    if digest:
                        out.append((*run, digest.hexdigest()))
                    run, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield _batch(out, ("depth", "conv_id"), "ends_sha256")
        if digest:
            yield _batch([(*run, digest.hexdigest())], ("depth", "conv_id"), "ends_sha256")

    order = ["depth", "node", "member"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(hashes, "depth long, conv_id long, ends_sha256 string")


def _batch(rows: list[tuple], numbers: tuple[str, ...], text: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(numbers, cols, strict=False)} | {text: pa.array(cols[-1], pa.string())})


def trie(rows: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the conversations in ``rows`` (conv_id, depth, key, words, upto, as ``shared_heads`` gives them).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes below or here), saved_tokens (words that
    members share with the node's least one, summed over the subtree), ends_sha256 (of the ids of members that end here).
    """
    whole = [F.max("depth").alias("length"), F.max("upto").alias("total"), *[F.bit_xor(F.when(F.col("depth") > 0, F.xxhash64("depth", "key", F.lit(s))).otherwise(0)).alias(f"x{s}") for s in (1, 2)]]
    live = keep(rows.groupBy("conv_id").agg(*whole).select("*", F.lit(None).cast("long").alias("parent")), "trie-live")
    levels, closed, ends, drop, depth = [], [], [], [], 0
    while total := live.count():
        here = rows.where(F.col("depth") == depth).select("conv_id", "key", "words", "upto")
        members = keep(live.join(here, "conv_id"), "trie-members")
        alike = F.struct("length", "x1", "x2")
        nodes = members.groupBy("parent", F.coalesce("key", F.lit(b"")).alias("key")).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("upto").alias("upto"), F.min("length").alias("length"), F.min("total").alias("total"), (F.min(alike) == F.max(alike)).alias("closed"))
        nodes = keep(nodes.withColumn("depth", F.lit(depth).cast("long")), "trie-nodes")
        named = members.withColumnRenamed("conv_id", "member").select("member", "length", F.col("total").alias("words_all"), "x1", "x2", F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("key", F.lit(b"")).alias("key"))
        found = keep(_with_nodes(named, nodes.select(F.coalesce("parent", F.lit(-1)).alias("parent"), "key", "conv_id", "n_convs", "closed"), total), "trie-found")
        ends.append(found.where(F.col("hot.closed") | (F.col("length") == depth)).select(F.col("length").alias("depth"), F.col("hot.conv_id").alias("node"), "member"))
        levels.append(nodes)
        closed.append(nodes.where("closed").select("conv_id", F.col("depth").alias("from"), "n_convs", "length", "total"))
        drop += [live, members]
        live = keep(found.where(~F.col("hot.closed") & (F.col("length") > depth)).select(F.col("member").alias("conv_id"), "length", F.col("words_all").alias("total"), "x1", "x2", F.col("hot.conv_id").alias("parent")), "trie-live")
        depth += 1
    rolled, below, shape = [], None, ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    for nodes in reversed(levels):
        shared = (F.col("n_convs") - 1) * F.when(F.col("closed"), F.col("total") - F.col("upto") + F.col("words")).otherwise(F.col("words"))
        if below is None:
            nodes = nodes.select("*", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        else:
            inner = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(inner, "conv_id", "left").fillna(0, ["children", "leaves", "saved"])
        children = F.when(F.col("closed"), (F.col("length") > F.col("depth")).cast("long")).otherwise(F.col("children"))
        below = keep(nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", children.alias("n_children"), F.when(F.col("closed"), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), (shared + F.col("saved")).alias("saved_tokens")), "trie-rolled")
        rolled.append(below)
    if not levels:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    block = lambda x: F.floor(x / BLOCK)
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    heads = union(closed).where("length > `from`").select("*", F.explode(F.sequence(block(F.col("from") + 1), block(F.col("length")))).alias("block"))
    chain = rows.withColumn("block", block(F.col("depth"))).join(heads, ["conv_id", "block"]).where("depth > `from`")
    chain = chain.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("words"))).alias("saved_tokens"))
    ended = keep(_ends(union(ends)), "trie-ends")
    out = union([*rolled, chain]).select(*shape).join(ended, ["depth", "conv_id"], "left")
    discard(*drop)
    return out.select(*shape, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(shared_heads(turns(table(spark, sf_dir, "conversations"))))


ORACLE = r"""WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a // 256, tab[1 + xor(a, b) % 256])), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
x AS (SELECT c.conv_id, t.pos, key, words, 0 AS part FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h UNION ALL SELECT c.conv_id, t.pos, key, words, 1 FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
y AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS prefix, words FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
z AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM y),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM z GROUP BY 1, 2),
k AS (SELECT *, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND starts_with(m.prefix, n.prefix)) AS n_children FROM n)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM k a JOIN k b ON starts_with(b.prefix, a.prefix) LEFT JOIN k p ON p.depth = a.depth - 1 AND starts_with(a.prefix, p.prefix) GROUP BY ALL"""
