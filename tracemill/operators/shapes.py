"""Shapes of JSON bodies: what is left of them without their values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, materialised

#: Levels below the body that are looked at.
DEPTH = 8
#: Bodies of one round; what a task sorts is bounded by them, however many there are.
ROUND = 2_000_000
_SCALARS = {'"': "string", "n": "null", "t": "boolean", "f": "boolean"}


def _kind(v: str) -> Column:
    """The first character of the value's JSON text, which tells its type."""
    return F.expr(f"substr(to_json({v}), 1, 1)")


def _plain(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == c, name) for c, name in _SCALARS.items()], F.lit("number"))


def _in_rounds(df: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``ROUND`` rows or so at a time, dealt by their keys: the number of a shuffle's partitions is fixed, so a task of one round over all rows would hold ever more. All rows are written once, apart by round."""
    rounds = -(-df.count() // ROUND)
    if rounds < 2:
        return work(df)
    dealt = materialised(df.withColumn("_round", F.pmod(F.xxhash64("key"), F.lit(rounds)).cast("int")), "shape-rows", by="_round")
    done = [materialised(work(dealt.where(F.col("_round") == i).drop("_round")), "shape-round") for i in range(rounds)]
    discard(dealt)
    return reduce(DataFrame.unionByName, done)


def shape_signatures(bodies: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, signature) of bodies (key, body) that are JSON: keys in order, values as ``string``, ``number``, ``boolean`` or ``null``, arrays as the different shapes of their elements in order; ``…`` below ``depth`` levels.

    ``key`` tells the rows apart. Each round explodes one level of all bodies at once; then the levels are folded back up from the deepest. So a body of any size is spread over tasks, and an array of like elements is one shape
before it is gathered. A body that names a key of one object twice is no JSON here.
    """
    return _in_rounds(bodies.select("key", "body"), lambda some: _signatures(some, depth))


def _signatures(bodies: DataFrame, depth: int) -> DataFrame:
    levels = [materialised(bodies.select("key", F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), F.expr("try_parse_json(body)").alias("v")).where("v is not null").withColumn("kind", _kind("v")), "json-level")]
    for d in range(1, depth + 2):
        inner = levels[-1].where("kind IN ('{', '[')")
        if inner.isEmpty():
            break
        found = inner.sparkSession.sql("SELECT t.key, concat(t.path, '.', e.pos) AS path, e.key AS name, e.value AS v FROM {t} AS t, LATERAL variant_explode(t.v) AS e", t=inner)
        levels.append(materialised(found.withColumn("kind", F.lit("…") if d > depth else _kind("v")), "json-level"))
    below = None
    for level in reversed(levels):
        up = F.regexp_replace("path", r"\.[0-9]+$", "")
        shape = F.when(F.col("kind") == "…", "…").otherwise(_plain(F.col("kind")))
        if below is not None:
            # The different shapes of an array's elements; the names of an object with theirs, each once.
            parts = below.groupBy("key", "up").agg(F.array_sort(F.collect_set("part")).alias("parts"))
            level = level.join(parts.withColumnRenamed("up", "path"), ["key", "path"], "left")
            text = lambda sep: F.array_join(F.coalesce("parts", F.array().cast("array<string>")), sep)
            names = F.array_join(F.transform(F.coalesce("named", F.array().cast("array<struct<name:string,shape:string>>")), lambda x: F.concat(x["name"], F.lit(":"), x["shape"])), ",")
            level = level.join(below.where("name is not null").groupBy("key", "up").agg(F.array_sort(F.collect_list(F.struct("name", "shape"))).alias("named")).withColumnRenamed("up", "path"), ["key", "path"], "left")
            shape = F.when(F.col("kind") == "{", F.concat(F.lit("{"), names, F.lit("}"))).when(F.col("kind") == "[", F.concat(F.lit("["), text("|"), F.lit("]"))).otherwise(shape)
        else:
            shape = F.when(F.col("kind") == "{", "{}").when(F.col("kind") == "[", "[]").otherwise(shape)
        folded = level.select("key", "path", up.alias("up"), "name", shape.alias("shape")).withColumn("part", F.when(F.col("name").isNull(), F.col("shape")))
        below = materialised(folded, "json-shapes")
    out = below.select("key", F.col("shape").alias("signature"))
    discard(*levels)
    return out


def shape_hashes(responses: DataFrame) -> DataFrame:
    """(key, shape) of responses (key, body, content_type): ``empty``; ``json:`` and the beginning of the signature's hash for what is marked as JSON or begins like it and is JSON; else ``raw:`` and the content type without its parameters."""
    return _in_rounds(responses.select("key", "body", "content_type"), _hashes)


def _hashes(responses: DataFrame) -> DataFrame:
    kind = F.coalesce("content_type", F.lit(""))
    jsonish = kind.contains("json") | F.substring("body", 1, 64).rlike(r'^\s*[\[{"]')
    full = responses.where("body is not null AND body <> ''")
    signed = _signatures(full.where(jsonish).select("key", "body"), DEPTH)
    plain = F.trim(F.split(F.coalesce("content_type", F.lit("unknown")), ";")[0])
    # Without their bodies, which the join need not sort.
    out = responses.select("key", (F.coalesce("body", F.lit("")) == "").alias("bare"), "content_type").join(signed, "key", "left")
    shape = F.when(F.col("bare"), "empty").when(F.col("signature").isNotNull(), F.concat(F.lit("json:"), F.substring(F.sha2("signature", 256), 1, 16)))
    return out.select("key", shape.otherwise(F.concat(F.lit("raw:"), F.when(plain == "", "unknown").otherwise(plain))).alias("shape"))
