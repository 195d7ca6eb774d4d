"""Joins of what ran with what is known: components with chunks of code and overlays, responses with learned invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .skew import spread_join
from .statistics import chance_probability


def qualified_match(component: Column, module: Column, name: Column) -> Column:
    """Does ``component`` (module.name, or module.Class.name) mean ``name`` of ``module``? The module may lack outer packages on either side."""
    parts = F.split(component, r"\.")
    n = F.size(parts)
    within = lambda k: F.array_join(F.slice(parts, 1, F.greatest(n - k, F.lit(0))), ".")
    same = lambda c: (c == module) | c.endswith(F.concat(F.lit("."), module)) | module.endswith(F.concat(F.lit("."), c))
    return (F.element_at(parts, -1) == name) & (same(within(1)) | ((n >= 3) & same(within(2))))


def component_chunks(components: DataFrame, chunks: DataFrame) -> DataFrame:
    """(component, id): the chunk of the component's last name; of several the one in whose path most of the other segments of the component stand, of these the first.

    ``chunks``: id, name, file. Components are taken once each. Only the best chunk of a component so far is kept where a task meets several.
    """
    each = components.select("component").where("component is not null").distinct().withColumn("name", F.element_at(F.split("component", r"\."), -1))
    path = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    outer = F.split("component", r"\.")
    score = F.size(F.filter(F.slice(outer, 1, F.size(outer) - 1), lambda s: F.contains(path, s)))
    both = spread_join(each, chunks.select("id", "name", "file"), ["name"], "name")
    return both.select("component", "id", score.alias("score")).groupBy("component").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"))


def overlay_lookup(components: DataFrame, overlay: DataFrame) -> DataFrame:
    """``components`` with the overlay's row (struct ``overlay``) of the component itself, else of what it is in, else null. ``overlay``: component, unique, and what it says."""
    said = overlay.select(F.col("component").alias("_name"), F.struct(*[c for c in overlay.columns if c != "component"]).alias("_row"))
    rows = components.withColumn("_up", F.regexp_replace("component", r"\.?[^.]*$", ""))
    rows = spread_join(rows.withColumn("_name", F.col("component")), said, ["_name"], "_name", "left").withColumnRenamed("_row", "_exact").drop("_name")
    rows = spread_join(rows.withColumn("_name", F.col("_up")), said, ["_name"], "_name", "left").drop("_name")
    return rows.select(*components.columns, F.coalesce("_exact", "_row").alias("overlay"))


def response_fields(responses: DataFrame) -> DataFrame:
    """(key, field, kind, text, number) of the top-level fields of JSON bodies; of an array of records those of the first one. Kind: ``string``, ``number``, ``boolean``, ``null``, ``object`` or ``array``."""
    top = responses.select("key", F.expr("try_parse_json(body)").alias("v")).where("v is not null")
    top = top.select("key", F.expr("CASE WHEN substr(to_json(v), 1, 1) = '[' THEN try_variant_get(v, '$[0]', 'variant') ELSE v END").alias("v")).where("substr(to_json(v), 1, 1) = '{'")
    each = top.sparkSession.sql("SELECT t.key, e.key AS field, e.value AS v, substr(to_json(e.value), 1, 1) AS c FROM {t} AS t, LATERAL variant_explode(t.v) AS e", t=top)
    kind = F.coalesce(*[F.when(F.col("c") == c, k) for c, k in {'"': "string", "n": "null", "t": "boolean", "f": "boolean", "{": "object", "[": "array"}.items()], F.lit("number"))
    text = F.when(kind.isin("string", "boolean"), F.expr("CAST(v AS STRING)"))
    return each.select("key", "field", kind.alias("kind"), text.alias("text"), F.when(kind == "number", F.expr("try_variant_get(v, '$', 'double')")).alias("number"))


def invariant_violations(responses: DataFrame, invariants: DataFrame, *, confidence: float = 0.8, chance: float = 0.10) -> DataFrame:
    """(key, violations): healthy responses that break invariants of their endpoint, the broken ones as ``kind field`` in order.

    ``responses``: key, endpoint, status (2xx and 3xx are healthy), body, input_size, output_size. ``invariants``: endpoint, field, kind, support, confidence, values (array of texts, for ``stable_enum``), low, high (for ``numeric_bound``). An invariant counts with enough confidence and little
    chance to have held by luck. ``never_null`` is broken by a record without the field, not by a body without a record; ``stable_enum`` by another text or boolean; ``numeric_bound`` by a number outside, but not for ids; ``size_relation`` by an output larger than its input.
    """
    healthy = responses.where("status >= 200 AND status < 400").select("key", "endpoint", "body", F.coalesce("input_size", F.lit(0)).alias("input_size"), F.coalesce("output_size", F.lit(0)).alias("output_size"))
    fields = materialised(response_fields(healthy), "fields")
    kinds = F.size(F.coalesce("values", F.array().cast("array<string>")))
    luck = F.when(F.coalesce("support", F.lit(0)) <= 0, 1.0).when(F.col("kind").isin("numeric_bound", "stable_enum", "never_null", "size_relation"), chance_probability(F.col("kind"), F.col("support"), kinds)).otherwise(0.0)
    kept = invariants.where((F.coalesce("confidence", F.lit(0.0)) >= confidence) & (luck <= chance))
    kept = kept.where(~((F.col("kind") == "numeric_bound") & F.lower(F.coalesce("field", F.lit(""))).rlike("(^|_)id$")))
    judged = spread_join(healthy.drop("body"), kept.select("endpoint", F.col("field").alias("name"), F.col("kind").alias("rule"), "values", "low", "high"), ["endpoint"], "endpoint")
    judged = judged.join(fields.select("key", F.lit(True).alias("record")).distinct(), "key", "left")
    seen = fields.select("key", F.col("field").alias("name"), "kind", "text", "number")
    rows = judged.join(seen, ["key", "name"], "left")
    finite = F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") < float("inf"))
    broken = F.coalesce(
        F.when(F.col("rule") == "never_null", F.col("record").isNotNull() & (F.col("kind").isNull() | (F.col("kind") == "null"))),
        F.when(F.col("rule") == "stable_enum", (F.size("values") > 0) & F.col("text").isNotNull() & ~F.array_contains("values", F.col("text"))),
        F.when(F.col("rule") == "numeric_bound", finite & F.col("low").isNotNull() & F.col("high").isNotNull() & ~F.col("number").between(F.col("low"), F.col("high"))),
        F.when(F.col("rule") == "size_relation", (F.col("input_size") > 0) & (F.col("output_size") > F.col("input_size"))), F.lit(False))
    what = F.trim(F.concat_ws(" ", "rule", "name"))
    return rows.where(broken).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(what)), "; ").alias("violations"))  # no more than an endpoint has invariants
