"""What lies above a place in the code: the endpoints that run it, and the guards that files take over from what they import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .skew import spread_join

# Packages for cryptography and credentials.
GUARDED_ROOTS = "hmac secrets bcrypt passlib pwdlib argon2 scrypt jwt jose cryptography nacl Crypto Cryptodome oauthlib authlib itsdangerous".split()


def _tails(name: Column, mark: str) -> Column:
    """All endings of a name that begin at one of its parts, itself first."""
    parts = F.split(name, "[.]" if mark == "." else mark)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), mark))


def same_endings(left: DataFrame, right: DataFrame, a: str, b: str, mark: str) -> DataFrame:
    """(a, b) of different names of which one is the other or ends with it after a ``mark``: equal to an ending of the other, so two joins by keys."""
    one, two = left.select(a).where(F.col(a).isNotNull()).distinct(), right.select(b).where(F.col(b).isNotNull()).distinct()
    short = spread_join(two.withColumn("_k", F.explode(_tails(F.col(b), mark))), one.withColumn("_k", F.col(a)), ["_k"], "_k")
    long = spread_join(one.withColumn("_k", F.explode(_tails(F.col(a), mark))), two.withColumn("_k", F.col(b)), ["_k"], "_k")
    return short.select(a, b).unionByName(long.select(a, b)).distinct()


def _path(file: Column) -> Column:
    return F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"^\./", "")


def reaching_endpoints(endpoints: DataFrame, nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(endpoint, depth): the endpoints nearest above the files of ``targets`` (id), by steps from a file to the files that call into it.

    ``endpoints``: endpoint, file. ``nodes``: id, file. ``edges``: src, dst, kind; only ``invoke`` between different files counts. Files are equal where one path ends with the other. Only the endpoints of the least depth are returned. One round for each step; a file is looked at once.
    """
    files = nodes.select("id", "file")
    side = lambda c: files.select(F.col("id").alias(c), F.col("file").alias(f"{c}_file"))
    calls = edges.where("kind = 'invoke'").join(side("src"), "src").join(side("dst"), "dst").where("src_file <> dst_file")
    calls = materialised(calls.select(F.col("dst_file").alias("file"), F.col("src_file").alias("caller")).distinct(), "file-callers")
    front = materialised(files.join(targets.select("id").distinct(), "id").where("file is not null").select("file").distinct().withColumn("depth", F.lit(0)), "reaching")
    seen, depth = front, 0
    while not front.isEmpty():
        depth += 1
        fresh = front.join(calls, "file").select(F.col("caller").alias("file")).distinct().join(seen.select("file"), "file", "left_anti")
        front = materialised(fresh.withColumn("depth", F.lit(depth)), "reaching")
        seen = seen.unionByName(front)
    near = seen.select(_path(F.col("file")).alias("here"), "depth")
    named = endpoints.select("endpoint", _path(F.col("file")).alias("there"))
    found = same_endings(near, named, "here", "there", "/").join(near, "here").groupBy("there").agg(F.min("depth").alias("depth"))
    found = named.join(found, "there").groupBy("endpoint").agg(F.min("depth").alias("depth"))
    least = found.agg(F.min("depth").alias("_least"))
    return found.join(F.broadcast(least), F.col("depth") == F.col("_least")).select("endpoint", "depth")


def security_guards(imports: DataFrame, roots: list[str] = GUARDED_ROOTS) -> DataFrame:
    """(file, guard, via): files that import a package for cryptography or credentials (``guard``: the packages; ``via``: null), and those that import one of these files (``via``: the imported module, the first of its kind by place). Guards go one step and no further.

    ``imports``: file, module (dotted), place (order in the file).
    """
    rows = materialised(imports.select("file", "module", "place").where("file is not null AND module is not null"), "imports")
    direct = rows.withColumn("root", F.split("module", "[.]")[0]).where(F.col("root").isin(*roots)).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("root")), ", ").alias("guard"))  # no more than there are roots
    direct = materialised(direct, "guards")
    names = direct.select("file", F.replace(F.regexp_replace("file", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("dotted"), "guard")
    others = rows.join(direct.select("file"), "file", "left_anti")
    meets = same_endings(names, others, "dotted", "module", ".").join(names.groupBy("dotted").agg(F.min(F.struct("file", "guard")).alias("of")), "dotted").groupBy("module").agg(F.min("of").alias("of"))
    taken = spread_join(others, meets, ["module"], "module").groupBy("file").agg(F.min(F.struct("place", "module", "of")).alias("x"))
    return direct.select("file", "guard", F.lit(None).cast("string").alias("via")).unionByName(taken.select("file", F.col("x.of.guard").alias("guard"), F.col("x.module").alias("via")))
