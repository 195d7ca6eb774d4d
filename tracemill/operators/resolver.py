"""Call graphs from names: references of symbols are resolved by ranked joins.

Every rule looks the referenced name up in another scope: files of the receiver's name, the own file, the whole repository, or the
directories above the own file. A scope's symbols of one name are one row (how many, and the first two), so no reference meets the
single candidates. What a file's references to one name find is looked up once for all of them; a reference meets it as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .skew import spread_join

# Method names of standard libraries, which a reference through a receiver does not resolve to by name alone.
LIBRARY_NAMES = """get set add pop clear copy update remove format append extend insert sort reverse index count keys values items split rsplit
join strip lstrip rstrip lower upper title replace startswith endswith encode decode read write close flush seek tell open exists
mkdir unlink rename resolve glob stat commit rollback execute fetchone fetchall scalar scalars first one merge refresh
delete filter search match group sub compile dumps loads dump load sleep now today utcnow strftime strptime isoformat
timestamp send recv connect accept bind listen json text push shift unshift slice splice concat includes indexOf forEach map
find next min max sum any all""".split()
OWN = ("self", "cls", "this")
MAX_CANDIDATES, LIBRARY_REFERENCES = 8, 25


def reference_parts(ref: Column) -> dict[str, Column]:
    """``a.b.f``: its name ``f``, the root ``a`` of its receiver, whether it has a receiver, and whether that is another object than the caller's own."""
    name = F.regexp_extract(ref, r"[^.]*$", 0)
    receiver = F.when(F.length(name) < F.length(ref), F.substring(ref, 1, F.length(ref) - F.length(name) - 1)).otherwise("")
    root = F.regexp_extract(receiver, r"^[^.]*", 0)
    return {"name": name, "root": root, "dotted": F.length(name) < F.length(ref), "through": (receiver != "") & ~root.isin(*OWN)}


def file_stem(file: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(file, r"[^/\\]*$", 0), r"^[^.]*", 0)


def directories(file: Column) -> Column:
    """Each directory on the way to a file, the outermost first: (level from 1, path)."""
    parts = F.split(file, r"[/\\]")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(dirs, lambda _, i: F.struct((i + 1).alias("level"), F.array_join(F.slice(dirs, 1, i + 1), "/").alias("path")))


def _scopes(symbols: DataFrame) -> DataFrame:
    """name, scope, place, n, first, second: the symbols of one name in one place of a scope."""
    one = lambda scope, place: F.struct(F.lit(scope).alias("scope"), place.alias("place"))
    places = F.concat(F.array(one("stem", file_stem(F.col("file"))), one("file", F.col("file")), one("all", F.lit("")), one("lang", F.col("lang"))), F.transform(directories(F.col("file")), lambda d: one("dir", d["path"])))
    each = symbols.select("id", "name", F.explode(places).alias("x")).select("id", "name", "x.*")
    key = ["name", "scope", "place"]
    two = each.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where("k <= 2").groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("second"))
    return each.groupBy(*key).agg(F.count("*").alias("n")).join(two, key)


def resolve(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """``references`` with what each one resolves to.

    ``symbols``: id, name, file, lang (may be null). ``references``: src (symbol that refers, its file counts), ref, kind (``invoke`` or another), distinct.
    In this order: through a receiver that has a file's name, the first symbol of the name there; for names of standard libraries with any receiver, the only one of the own
    file, else none; the first one in the own file; the only one at all; the only one below the deepest shared directory. Who calls
    through a receiver does not call itself. Returns src, ref, kind, name, root, through, dst (null: none), rule, n_named (symbols of the name), n_lang and lang_dst (those of the caller's language, the first one).
    """
    parts = reference_parts(F.col("ref"))
    caller = symbols.select(F.col("id").alias("src"), F.col("name").alias("own_name"), "file", "lang")
    refs = references.select("src", "ref", "kind").join(caller, "src").select("*", *[c.alias(n) for n, c in parts.items()])
    refs = materialised(refs.withColumn("aside", F.col("through") & (F.col("kind") == "invoke") & (F.col("own_name") == F.col("name"))).drop("own_name"), "references")
    scopes = materialised(_scopes(symbols), "scopes")
    one = lambda scope, place, level=None: F.struct(F.lit(scope).alias("scope"), place.alias("place"), (F.lit(0) if level is None else level).alias("level"))
    probes = F.concat(F.array(one("file", F.col("file")), one("all", F.lit("")), one("lang", F.col("lang"))), F.transform(directories(F.col("file")), lambda d: one("dir", d["path"], d["level"])))
    asked = refs.select("name", "file", "lang").distinct().select("*", F.explode(probes).alias("x")).select("name", "file", "lang", "x.*")
    row = F.struct("n", "first", "second")
    pick = lambda scope: F.max(F.when(F.col("scope") == scope, row))
    above = F.collect_list(F.when(F.col("scope") == "dir", F.struct("level", "n", "first", "second")))  # as many as the file has directories above it
    found = spread_join(asked, scopes, ["name", "scope", "place"], "name").groupBy("name", "file", "lang").agg(pick("file").alias("_file"), pick("all").alias("_all"), pick("lang").alias("_lang"), above.alias("_dirs"))
    # References through a receiver that has a file's name. Joins of references are by sorting, where Spark cuts what is frequent.
    stems = scopes.where("scope = 'stem'").select("name", F.col("place").alias("root"), row.alias("_stem"), F.lit(True).alias("through"))
    out = refs.join(stems, ["name", "root", "through"], "left").withColumnsRenamed({"file": "_f", "lang": "_l", "name": "_n"})
    out = out.join(found, (F.col("_n") == F.col("name")) & (F.col("_f") == F.col("file")) & F.col("_l").eqNullSafe(F.col("lang")), "left")
    # The caller itself is no candidate, where it is in the scope (it is in all of its own file's, and in another stem's never). The language's candidates are counted with it.
    left = lambda x, inside: x["n"] - inside.cast("int")
    to = lambda x, inside: F.when(inside & (x["first"] == F.col("src")), x["second"]).otherwise(x["first"])
    aside, stem, own, every = F.col("aside"), F.col("_stem"), F.col("_file"), F.col("_all")
    in_stem = aside & (F.col("root") == file_stem(F.col("_f")))
    near = F.filter(F.transform("_dirs", lambda d: F.struct(d["level"].alias("level"), left(d, aside).alias("left"), to(d, aside).alias("to"))), lambda d: d["left"] > 0)
    keys = ["src", "ref", "kind"]
    out = out.select(
        *keys, F.col("_n").alias("name"), "root", "dotted", "through", F.when(F.col("_f").isNotNull() & (left(stem, in_stem) > 0), to(stem, in_stem)).alias("stem"), F.when(left(own, aside) > 0, to(own, aside)).alias("own"), F.when(left(own, aside) > 0, left(own, aside)).alias("n_own"),
        to(every, aside).alias("one"), left(every, aside).alias("n_all"), every["n"].alias("n_named"), F.array_max(near).alias("near"), F.col("_lang.n").alias("n_lang"), F.col("_lang.first").alias("lang_dst"))
    guarded = F.col("dotted") & F.col("name").isin(*LIBRARY_NAMES)
    rules = [
        ("stem", F.col("through") & F.col("stem").isNotNull(), F.col("stem")), ("file", guarded & (F.col("n_own") == 1), F.col("own")), (None, guarded, F.lit(None).cast("long")),
        ("file", F.col("own").isNotNull(), F.col("own")), ("unique", F.col("n_all") == 1, F.col("one")), ("nearest", F.col("near.left") == 1, F.col("near.to")),
    ]
    rule = dst = None
    for name, holds, to in rules:
        rule = F.when(holds, F.lit(name)) if rule is None else rule.when(holds, F.lit(name))
        dst = F.when(holds, to) if dst is None else dst.when(holds, to)
    return out.select(*keys, "name", "root", "through", dst.alias("dst"), rule.alias("rule"), F.coalesce("n_named", F.lit(0)).alias("n_named"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), "lang_dst")


def call_graph(symbols: DataFrame, references: DataFrame, overrides: DataFrame | None = None, *, max_candidates: int = MAX_CANDIDATES, library_references: int = LIBRARY_REFERENCES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, pending, stats) of a repository.

    ``symbols``: id, name, file, lang, parent (name of the container, may be null). ``references``: src, ref, kind (``invoke``, ``inherit``). ``overrides``: src, dst, kind of edges that are settled: a
    call by the same symbol of the same name is not resolved again. Edges: src, dst, kind, each once and none to itself. Pending: src, ref, candidates of calls that
    several symbols of the caller's language could answer. Stats: reason, n of calls that are settled by language or not worth asking: through a receiver that the repository does not
    define; no candidate in the caller's language; more than ``max_candidates``; names called through receivers ``library_references`` times and more than twice as often as there are candidates.
    """
    spark = symbols.sparkSession
    if overrides is None:
        overrides = spark.createDataFrame([], "src long, dst long, kind string")
    ids = symbols.select("id")
    overrides = overrides.join(ids.withColumnRenamed("id", "src"), "src", "semi").join(ids.withColumnRenamed("id", "dst"), "dst", "semi").select("src", "dst", "kind")
    settled = overrides.join(symbols.select(F.col("id").alias("dst"), "name"), "dst").select("src", "name").distinct()
    inside = symbols.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("ref"), F.lit("contains").alias("kind"))
    # Dealt by the symbol that refers, references are made distinct and meet their callers and what is settled without being shuffled again.
    refs = references.where("ref is not null").select("src", "ref", "kind").unionByName(inside).repartition("src").distinct()
    done = settled.groupBy("src").agg(F.collect_set("name").alias("done"))
    again = (F.col("kind") == "invoke") & F.coalesce(F.array_contains("done", reference_parts(F.col("ref"))["name"]), F.lit(False))
    got = materialised(resolve(symbols, refs.join(done, "src", "left").where("kind is not null").where(~again).select("src", "ref", "kind")), "resolved")
    open_calls = got.where("dst is null AND kind = 'invoke' AND n_named > 1")
    owned = symbols.select(F.explode(F.array("name", file_stem(F.col("file")))).alias("root")).distinct().withColumn("owned", F.lit(True))
    judged = spread_join(open_calls, owned, ["root"], "root", "left")
    reason = F.when(F.col("through") & F.col("owned").isNull(), "external_receiver").when(F.col("n_lang") == 0, "cross_lang").when(F.col("n_lang") == 1, "resolved_by_lang").when(F.col("n_lang") > max_candidates, "generic_name")
    judged = materialised(judged.select("src", "ref", "name", "through", "n_lang", "lang_dst", reason.alias("reason")), "judged")
    uses = judged.where("reason is null AND through").groupBy("name").agg(F.count("*").alias("uses"))
    staged = spread_join(judged.where("reason is null"), uses, ["name"], "name", "left")
    library = F.col("through") & (F.col("uses") >= library_references) & (F.col("uses") > 2 * F.col("n_lang"))
    staged = staged.select("src", "ref", "name", F.coalesce(library, F.lit(False)).alias("library"))
    reasons = judged.where("reason is not null").select("reason").unionByName(staged.where("library").select(F.lit("library_method").alias("reason")))
    langs = symbols.select(F.col("id").alias("src"), "lang")
    few = symbols.groupBy("name", "lang").agg(F.count("*").alias("n")).where(F.col("n") <= max_candidates).select("name", "lang")
    named = symbols.join(few, ["name", "lang"]).groupBy("name", "lang").agg(F.array_sort(F.collect_list("id")).alias("candidates"))  # max_candidates each at most
    pending = spread_join(staged.where("NOT library").join(langs, "src"), named, ["name", "lang"], "name").select("src", "ref", "candidates")
    to = lambda df, kind: df.select(F.when(kind == "contains", F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(kind == "contains", F.col("src")).otherwise(F.col("dst")).alias("dst"), kind.alias("kind"))
    by_lang = judged.where("reason = 'resolved_by_lang'").select("src", F.col("lang_dst").alias("dst"), F.lit("invoke").alias("kind"))
    edges = overrides.unionByName(to(got.where("dst is not null"), F.col("kind"))).unionByName(by_lang).where("src <> dst").distinct()
    return edges, pending, reasons.groupBy("reason").agg(F.count("*").alias("n"))
