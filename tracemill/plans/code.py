"""Queries of the code-graph operators: parts are symbols, line items refer from one part to another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, joining, reach, resolver, walks
from ..registry import query
from ..sources.tables import read_table
from .queries import r

_SYMBOLS = [
    "p_partkey AS id", "CASE WHEN p_partkey % 13 = 0 THEN 'get' WHEN p_partkey % 17 = 0 THEN concat('only', p_partkey) ELSE concat('fn', p_partkey % 701) END AS name",
    "concat('pkg', p_size % 5, '/mod', p_partkey % 11, CASE WHEN p_partkey % 3 = 0 THEN '/deep' ELSE '' END, '/unit', p_partkey % 37, '.py') AS file",
    "CASE WHEN p_partkey % 7 = 0 THEN 'ts' ELSE 'py' END AS lang", "CASE WHEN p_partkey % 10 = 0 THEN concat('fn', (p_partkey + 1) % 701) END AS parent",
]
_REFERENCES = [
    "l_partkey AS src", "CASE WHEN l_linenumber = 7 THEN 'inherit' ELSE 'invoke' END AS kind",
    """concat(CASE l_suppkey % 6 WHEN 1 THEN 'self.' WHEN 2 THEN concat('unit', l_orderkey % 37, '.') WHEN 3 THEN concat('lib', l_orderkey % 9, '.x.') WHEN 4 THEN concat('unit', l_orderkey % 5, '.a.') ELSE '' END,
    CASE WHEN l_orderkey % 29 = 0 THEN 'get' WHEN l_orderkey % 23 = 0 THEN concat('only', l_orderkey % 200 * 17) ELSE concat('fn', l_orderkey % 750) END) AS ref""",
]
_SETTLED = ["l_partkey AS src", "l_suppkey AS dst", "'invoke' AS kind"]

_GRAPH = rf"""s AS (SELECT {', '.join(_SYMBOLS)} FROM part), sd AS (SELECT *, regexp_extract(file, '([^/.]*)[.][^/]*$', 1) AS stem, string_split(regexp_replace(file, '/[^/]*$', ''), '/') AS dirs FROM s),
o AS (SELECT DISTINCT src, dst, kind FROM (SELECT {', '.join(_SETTLED)} FROM lineitem WHERE l_orderkey % 97 = 0) JOIN s a ON a.id = src JOIN s b ON b.id = dst), settled AS (SELECT DISTINCT src, name FROM o JOIN s ON id = dst),
f AS (SELECT DISTINCT src, kind, ref, regexp_extract(ref, '[^.]*$') AS name FROM (SELECT {', '.join(_REFERENCES)} FROM lineitem)),
q AS (SELECT * FROM f WHERE NOT (kind = 'invoke' AND (src, name) IN (SELECT (src, name) FROM settled)) UNION ALL SELECT id, 'contains', parent, parent FROM s WHERE parent IS NOT NULL),
r AS (SELECT q.*, x.file, x.lang, x.dirs, contains(ref, '.') AS dotted, CASE WHEN contains(ref, '.') THEN string_split(ref, '.')[1] ELSE '' END AS root, contains(ref, '.') AND string_split(ref, '.')[1] NOT IN ('self', 'cls', 'this') AS through FROM q JOIN sd x ON x.id = src),
c AS (SELECT r.src, r.ref, r.kind, r.through, r.root, r.dotted, r.name, c.id, c.stem = r.root AND r.through AS by_stem, c.file = r.file AS own, len(list_filter(range(1, least(len(c.dirs), len(r.dirs)) + 1), lambda i: c.dirs[1:i] = r.dirs[1:i])) AS depth, NOT (r.through AND r.kind = 'invoke' AND c.id = r.src) AS fits, c.lang = r.lang AS same_lang FROM r JOIN sd c ON c.name = r.name),
d AS (SELECT *, max(depth) FILTER (fits) OVER (PARTITION BY src, ref, kind) AS deepest FROM c),
g AS (SELECT src, ref, kind, any_value(through) AS through, any_value(root) AS root, any_value(name) AS name, count(*) AS n_named, count(*) FILTER (same_lang) AS n_lang, min(id) FILTER (same_lang) AS lang_dst, list(id ORDER BY id) FILTER (same_lang) AS candidates,
CASE WHEN min(id) FILTER (by_stem AND fits) IS NOT NULL THEN min(id) FILTER (by_stem AND fits) WHEN any_value(dotted AND name = 'get') THEN CASE WHEN count(*) FILTER (own AND fits) = 1 THEN min(id) FILTER (own AND fits) END
WHEN min(id) FILTER (own AND fits) IS NOT NULL THEN min(id) FILTER (own AND fits) WHEN count(*) FILTER (fits) = 1 THEN min(id) FILTER (fits) WHEN max(deepest) > 0 AND count(*) FILTER (fits AND depth = deepest) = 1 THEN min(id) FILTER (fits AND depth = deepest) END AS dst FROM d GROUP BY 1, 2, 3),
j AS (SELECT *, CASE WHEN through AND root NOT IN (SELECT name FROM sd UNION SELECT stem FROM sd) THEN 'external_receiver' WHEN n_lang = 0 THEN 'cross_lang' WHEN n_lang = 1 THEN 'resolved_by_lang' WHEN n_lang > 8 THEN 'generic_name' END AS reason FROM g WHERE dst IS NULL AND kind = 'invoke' AND n_named > 1),
k AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN through AND count(*) FILTER (through AND reason IS NULL) OVER (PARTITION BY name) >= 25 AND count(*) FILTER (through AND reason IS NULL) OVER (PARTITION BY name) > 2 * n_lang THEN 'library_method' END AS why FROM j),
edges AS (SELECT DISTINCT * FROM (SELECT src, dst, kind FROM o UNION ALL SELECT CASE kind WHEN 'contains' THEN dst ELSE src END, CASE kind WHEN 'contains' THEN src ELSE dst END, kind FROM g WHERE dst IS NOT NULL UNION ALL SELECT src, lang_dst, 'invoke' FROM j WHERE reason = 'resolved_by_lang') WHERE src <> dst)"""


def _graph(spark, d):
    lines = read_table(spark, d, "lineitem")
    return resolver.call_graph(read_table(spark, d, "part").selectExpr(*_SYMBOLS), lines.selectExpr(*_REFERENCES), lines.where("l_orderkey % 97 = 0").selectExpr(*_SETTLED))


@query("call_graph_edges", f"WITH {_GRAPH} SELECT src, dst, kind FROM edges")
def _edges(spark, d):
    return _graph(spark, d)[0]


@query("pending_references", f"WITH {_GRAPH} SELECT src, ref, array_to_string(candidates, ',') AS candidates FROM k WHERE why IS NULL")
def _pending(spark, d):
    return _graph(spark, d)[1].withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query("reference_stats", f"WITH {_GRAPH} SELECT why AS reason, count(*) AS n FROM k WHERE why IS NOT NULL GROUP BY 1")
def _stats(spark, d):
    return _graph(spark, d)[2]


_LINKS = ["l_partkey AS src", "l_orderkey % 211 AS dst", "CASE l_linenumber % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'invoke' ELSE 'inherit' END AS kind"]
_FLOW = ["l_partkey AS src", "l_suppkey AS dst", "l_quantity AS calls"]
_BETA = {"invoke": 0.4, "inherit": 0.2, "contains": 0.1, "flow": 0.3}
_STEPS = 10  # log(0.001) / log(0.5)
_WALK = f"""s AS (SELECT {', '.join(_SYMBOLS)} FROM part), e AS (SELECT kind, src, dst, 1.0 AS w FROM (SELECT {', '.join(_LINKS)} FROM lineitem) UNION ALL SELECT 'flow', src, dst, ln(1 + calls) FROM (SELECT {', '.join(_FLOW)} FROM lineitem)),
v AS (SELECT e.* FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE src <> dst), n AS MATERIALIZED (SELECT kind, src, dst, sum(w) AS w FROM (SELECT * FROM v UNION ALL SELECT kind, dst, src, w FROM v) GROUP BY ALL),
b(kind, beta) AS (VALUES {', '.join(map(str, _BETA.items()))}), g AS (SELECT src, kind, sum(w) AS degree FROM n GROUP BY ALL), t AS MATERIALIZED (SELECT n.src, n.dst, sum(beta * w / degree) AS p FROM n JOIN g USING (src, kind) JOIN b USING (kind) GROUP BY 1, 2), o AS MATERIALIZED (SELECT src, sum(beta) AS out FROM g JOIN b USING (kind) GROUP BY 1),
z AS (SELECT id, 1 / (61 + row_number() OVER (ORDER BY id) - 1) / (SELECT count(*) FROM s x WHERE x.name = s.name) AS m FROM s WHERE id % 400 = 7), a AS MATERIALIZED (SELECT id, m / sum(m) OVER () AS s FROM z), p0 AS (SELECT id, s AS mass FROM a), {', '.join(f"""
l{k} AS (SELECT sum(mass * (1 - coalesce(out, 0))) AS lost FROM p{k - 1} LEFT JOIN o ON src = id), m{k} AS (SELECT dst AS id, sum(mass * p) AS got FROM p{k - 1} JOIN t ON src = id GROUP BY 1), p{k} AS MATERIALIZED (SELECT id, 0.5 * coalesce(s, 0) + 0.5 * (coalesce(got, 0) + lost * coalesce(s, 0)) AS mass FROM m{k} FULL JOIN a USING (id), l{k})""" for k in range(1, _STEPS + 1))}"""


@query("context_walk", f"WITH {_WALK} SELECT id, round(mass, 9) AS mass, id IN (SELECT id FROM a) AS anchor FROM p{_STEPS} WHERE mass > 0")
def _walk(spark, d):
    symbols, lines = read_table(spark, d, "part").selectExpr(*_SYMBOLS), read_table(spark, d, "lineitem")
    hits = symbols.where("id % 400 = 7").select("id", walks.anchor_weight(F.floor(F.col("id") / 400)).alias("weight"))
    return walks.context_walk(symbols, lines.selectExpr(*_LINKS), lines.selectExpr(*_FLOW), hits, beta=_BETA, alpha=0.5, tolerance=1e-3, budget=10**9).select("id", r("mass", 9).alias("mass"), "anchor")


_DEPTH = 3
_TREE = f"""k AS (SELECT DISTINCT l_partkey AS src, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS dst FROM lineitem), f0 AS (SELECT r_regionkey + 1 AS root, r_regionkey + 1 AS id, [r_regionkey + 1] AS path FROM region), seen0 AS (SELECT root, id FROM f0), {', '.join(f"""
m{i} AS (SELECT root, path, dst AS id FROM f{i - 1} JOIN k ON src = id), c{i} AS MATERIALIZED (SELECT m.*, m.id IS NOT NULL AND NOT EXISTS (FROM seen{i - 1} s WHERE s.root = m.root AND s.id = m.id) AS fresh, min(path) OVER (PARTITION BY root, m.id) AS least FROM m{i} m),
x{i} AS MATERIALIZED (SELECT root, CASE WHEN id IS NULL THEN path ELSE list_append(path, id) END AS path, {i} AS depth, id, CASE WHEN id IS NULL THEN 'external' WHEN NOT fresh THEN 'elsewhere' WHEN {i} > {_DEPTH} THEN 'truncated' WHEN path <> least THEN 'elsewhere' WHEN id IN (SELECT src FROM k) THEN 'expanded' ELSE 'leaf' END AS state FROM c{i}),
f{i} AS (SELECT root, id, path FROM x{i} WHERE state = 'expanded'), seen{i} AS (SELECT root, id FROM seen{i - 1} UNION SELECT root, id FROM x{i} WHERE state IN ('expanded', 'leaf'))""" for i in range(1, _DEPTH + 2))}, tree AS (SELECT root, path, 0 AS depth, id, CASE WHEN id IN (SELECT src FROM k) THEN 'expanded' ELSE 'leaf' END AS state FROM f0 {' '.join(f'UNION ALL SELECT * FROM x{i}' for i in range(1, _DEPTH + 2))})"""


def _tree(spark, d):
    edges = read_table(spark, d, "lineitem").selectExpr("l_partkey AS src", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS dst")
    return walks.call_trees(edges, read_table(spark, d, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS root"), _DEPTH)


@query("call_trees", f"WITH {_TREE} SELECT root, array_to_string(path, '/') AS path, CAST(depth AS INT) AS depth, id, state FROM tree")
def _call_trees(spark, d):
    return _tree(spark, d).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("call_paths", f"WITH {_TREE} SELECT root, id, arg_min(array_to_string(path, '/'), (len(path), path)) AS path FROM tree WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2")
def _call_paths(spark, d):
    found = walks.path_to(_tree(spark, d), read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("supplier_dendrogram")
def _dendrogram(spark, d):
    pairs = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").cast("string").alias("component"))
    return clusters.request_linkage(pairs).withColumn("distance", r("distance"))


_COMPONENT = "concat('pkg', l_suppkey % 5, '.mod', l_orderkey % 11, CASE WHEN l_linenumber > 4 THEN '.deep' ELSE '' END, '.fn', l_partkey % 720)"


@query("component_chunks", f"""WITH s AS (SELECT {', '.join(_SYMBOLS)} FROM part), c AS (SELECT DISTINCT {_COMPONENT} AS component FROM lineitem), x AS (SELECT component, id, len(list_filter(string_split(component, '.')[:-2], lambda p: contains(file, p))) AS score FROM c JOIN s ON s.name = string_split(component, '.')[-1])
SELECT component, arg_max(id, (score, -id)) AS id FROM x GROUP BY 1""")
def _component_chunks(spark, d):
    return joining.component_chunks(read_table(spark, d, "lineitem").select(F.expr(_COMPONENT).alias("component")), read_table(spark, d, "part").selectExpr(*_SYMBOLS))


_OVERLAY = "concat('m', c_custkey % 7, CASE WHEN c_custkey % 2 = 0 THEN concat('.f', c_custkey % 50) ELSE '' END)"
_OVERLAID = "concat('m', o_custkey % 9, '.f', o_orderkey % 80)"


@query("overlay_lookup", f"""WITH v AS (SELECT {_OVERLAY} AS name, min(c_custkey) AS line FROM customer GROUP BY 1), o AS (SELECT o_orderkey, {_OVERLAID} AS component FROM orders)
SELECT o_orderkey, component, coalesce(a.line, b.line) AS line FROM o LEFT JOIN v a ON a.name = component LEFT JOIN v b ON b.name = string_split(component, '.')[1]""")
def _overlay(spark, d):
    overlay = read_table(spark, d, "customer").groupBy(F.expr(_OVERLAY).alias("component")).agg(F.min("c_custkey").alias("line"))
    found = joining.overlay_lookup(read_table(spark, d, "orders").select("o_orderkey", F.expr(_OVERLAID).alias("component")), overlay)
    return found.select("o_orderkey", "component", "overlay.line")


@query("invariant_violations", """WITH v AS (SELECT o_orderkey AS key, list_filter([CASE WHEN o_custkey % 10 = 0 THEN 'never_null cust' END, CASE WHEN o_totalprice NOT BETWEEN 50000 AND 250000 AND o_orderpriority <> '1-URGENT' THEN 'numeric_bound total' END, CASE WHEN o_orderkey % 3 = 0 THEN 'size_relation' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'stable_enum state' END], lambda x: x IS NOT NULL) AS v FROM orders WHERE o_orderkey % 4 < 2)
SELECT key, array_to_string(v, '; ') AS violations FROM v WHERE len(v) > 0""")
def _violations(spark, d):
    o = read_table(spark, d, "orders")
    body = """concat('[{"state": "', o_orderstatus, '", "total": ', o_totalprice, ', "cust": ', CASE WHEN o_custkey % 10 = 0 THEN 'null' ELSE CAST(o_custkey AS STRING) END, ', "order_id": ', o_orderkey, '}]')"""
    rows = o.selectExpr("o_orderkey AS key", "o_orderpriority AS endpoint", "CAST(200 + 100 * (o_orderkey % 4) AS INT) AS status", f"{body} AS body", "100 AS input_size", "CASE WHEN o_orderkey % 3 = 0 THEN 101 ELSE 100 END AS output_size")
    learned = [("cust", "never_null", 40, None, None, None), ("state", "stable_enum", 40, ["F", "O"], None, None), ("total", "numeric_bound", 40, None, 50000.0, 250000.0), ("order_id", "numeric_bound", 40, None, 0.0, 1.0), (None, "size_relation", 40, None, None, None)]
    kinds = spark.createDataFrame(learned, "field string, kind string, support long, values array<string>, low double, high double")
    # The range of one endpoint was learned from too few responses to count.
    few = F.when((F.col("endpoint") == "1-URGENT") & (F.col("kind") == "numeric_bound"), 5).otherwise(F.col("support"))
    known = o.select(F.col("o_orderpriority").alias("endpoint")).distinct().join(F.broadcast(kinds), F.lit(True)).withColumns({"support": few, "confidence": F.lit(0.95)})
    return joining.invariant_violations(rows, known)


_CALLS = ["l_partkey AS src", "l_orderkey % 211 AS dst", "CASE WHEN l_linenumber = 1 AND l_orderkey % 9 = 0 THEN 'invoke' ELSE 'contains' END AS kind"]
_ENDPOINT = ["CAST(c_custkey AS STRING) AS endpoint", "concat('./mod', c_custkey % 11, CASE WHEN c_custkey % 4 = 0 THEN '/deep' ELSE '' END, '/unit', c_custkey % 37, '.py') AS file"]


@query("reaching_endpoints", f"""WITH RECURSIVE s AS (SELECT {', '.join(_SYMBOLS)} FROM part), c AS (SELECT DISTINCT b.file AS file, a.file AS caller FROM (SELECT {', '.join(_CALLS)} FROM lineitem) JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE kind = 'invoke' AND a.file <> b.file),
u AS (SELECT DISTINCT file, 0 AS depth FROM s JOIN region ON id = r_regionkey UNION SELECT caller, depth + 1 FROM u JOIN c USING (file) WHERE depth < 12), d AS (SELECT file, min(depth) AS depth FROM u GROUP BY 1), e AS (SELECT {', '.join(_ENDPOINT).replace('AS STRING', 'AS VARCHAR').replace("'./mod'", "'mod'")} FROM customer),
f AS (SELECT endpoint, min(depth) AS depth FROM e JOIN d ON d.file = e.file OR ends_with(d.file, '/' || e.file) GROUP BY 1) SELECT endpoint, CAST(depth AS INT) AS depth FROM f WHERE depth = (SELECT min(depth) FROM f)""")
def _reaching(spark, d):
    targets = read_table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    return reach.reaching_endpoints(read_table(spark, d, "customer").selectExpr(*_ENDPOINT), read_table(spark, d, "part").selectExpr(*_SYMBOLS), read_table(spark, d, "lineitem").selectExpr(*_CALLS), targets)


_IMPORT = ["concat('pkg', l_partkey % 90, '/m', l_partkey % 7, '.py') AS file", "l_orderkey AS place", "CASE WHEN l_partkey % 53 = 0 AND l_linenumber = 1 THEN 'jwt.api' WHEN l_partkey % 61 = 0 AND l_linenumber = 2 THEN 'bcrypt' ELSE concat('pkg', l_suppkey % 97, '.m', l_orderkey % 7) END AS module"]


@query("security_guards", f"""WITH i AS (SELECT {', '.join(_IMPORT)} FROM lineitem), g AS (SELECT file, array_to_string(list_sort(list(DISTINCT split_part(module, '.', 1))), ', ') AS guard FROM i WHERE split_part(module, '.', 1) IN ('jwt', 'bcrypt') GROUP BY 1),
n AS (SELECT i.file, arg_min(struct_pack(guard := guard, via := module), (place, module, g.file)) AS x FROM i JOIN g ON replace(replace(g.file, '.py', ''), '/', '.') = module WHERE i.file NOT IN (SELECT file FROM g) GROUP BY 1)
SELECT file, guard, CAST(NULL AS VARCHAR) AS via FROM g UNION ALL SELECT file, x.guard, x.via FROM n""")
def _guards(spark, d):
    return reach.security_guards(read_table(spark, d, "lineitem").selectExpr(*_IMPORT))
