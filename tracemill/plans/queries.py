"""Registered queries: each applies an operator to a whole test table; the SQL beside it must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import percentiles, predicates, text
from ..operators import aggregates, graph, lifecycle, ranges, retrieval, spans, statistics
from ..registry import query
from ..sources.tables import read_table
from .views import CALLS, HALVES, calls, halves


def r(x, n=6):
    return F.round(F.col(x) if isinstance(x, str) else x, n)


@query("rollup_events_hourly", f"""WITH {CALLS}, b AS (SELECT date_trunc('hour', ts) AS bucket, * FROM calls),
m AS (SELECT bucket, component, avg(n) AS mean_calls_per_request, max(n) AS max_calls_per_request FROM (SELECT bucket, component, request_id, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL)
SELECT CAST(b.bucket AS VARCHAR) AS bucket, b.component, count(*) AS calls, count(*) FILTER (status = 'error') AS error_count, round(quantile_cont(duration_ms, 0.5), 6) AS latency_p50, round(quantile_cont(duration_ms, 0.95), 6) AS latency_p95, round(quantile_cont(duration_ms, 0.99), 6) AS latency_p99,
round(any_value(mean_calls_per_request), 6) AS mean_calls_per_request, any_value(max_calls_per_request) AS max_calls_per_request, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, round(count(*) / 3600, 6) AS qps
FROM b JOIN m USING (bucket, component) GROUP BY b.bucket, b.component""")
def _rollup(spark, d):
    o = aggregates.rollup(calls(spark, d), "1 hour")
    return o.select(F.col("bucket").cast("string").alias("bucket"), "component", "calls", "error_count", *[r(f"latency_p{p}").alias(f"latency_p{p}") for p in (50, 95, 99)], r("mean_calls_per_request").alias("mean_calls_per_request"), "max_calls_per_request", r("error_rate").alias("error_rate"), r("qps").alias("qps"))


@query("symbol_stats", f"""WITH {CALLS}, s AS (SELECT component, count(*) AS calls, round(sum(duration_ms), 4) AS total_ms, count(*) FILTER (status = 'error') AS errors, CAST(max(ts) AS VARCHAR) AS last_seen, round(quantile_cont(duration_ms, 0.5), 6) AS p50, list_sort(list(duration_ms)) AS v FROM calls GROUP BY component)
SELECT component, calls, total_ms, errors, last_seen, p50, round(v[1 + CAST(floor(0.95 * (len(v) - 1)) AS INT)], 6) AS p95, round(v[1 + CAST(floor(0.99 * (len(v) - 1)) AS INT)], 6) AS p99, round(errors / calls, 6) AS error_rate FROM s""")
def _symbol_stats(spark, d):
    o = aggregates.symbol_stats(calls(spark, d))
    return o.select("component", "calls", r("total_ms", 4).alias("total_ms"), "errors", F.col("last_seen").cast("string").alias("last_seen"), *[r(c).alias(c) for c in ("p50", "p95", "p99", "error_rate")])


@query("request_rows", f"""WITH {CALLS}, q AS (SELECT request_id, arg_min(component, seq) FILTER (depth = 0) AS entry_component, arg_max(status, seq) FILTER (depth = 0) AS status, round(arg_max(duration_ms, seq) FILTER (depth = 0), 6) AS duration_ms, CAST(min(ts) AS VARCHAR) AS started, CAST(max(ts) AS VARCHAR) AS ended, count(*) AS calls FROM calls GROUP BY request_id) SELECT * FROM q""")
def _request_rows(spark, d):
    return aggregates.request_rows(calls(spark, d)).select("request_id", "entry_component", "status", r("duration_ms").alias("duration_ms"), F.col("started").cast("string").alias("started"), F.col("ended").cast("string").alias("ended"), "calls")


@query("trace_summary", f"WITH {CALLS} SELECT component, count(*) AS calls, count(DISTINCT request_id) AS requests, round(count(*) / (SELECT count(*) FROM calls), 6) AS share FROM calls GROUP BY component ORDER BY calls DESC, component LIMIT 20")
def _trace_summary(spark, d):
    return aggregates.trace_summary(calls(spark, d)).select("component", "calls", "requests", r("share").alias("share"))


@query("dependency_edges", f"WITH {CALLS} SELECT parent_component AS src, component AS dst, count(*) AS weight FROM calls WHERE parent_component IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def _dependency_edges(spark, d):
    return aggregates.dependency_edges(calls(spark, d))


_OUT = f"""{CALLS}, f AS (SELECT request_id, max(status = 'error') AS failed, arg_min(duration_ms, struct_pack(ts := ts, seq := seq)) AS first_ms FROM calls GROUP BY request_id), p AS (SELECT quantile_cont(duration_ms, 0.95) AS p95 FROM calls),
o AS (SELECT request_id, CASE WHEN failed AND first_ms > 1.5 * p95 THEN ['fail', 'slow'] WHEN failed THEN ['fail'] WHEN first_ms > 1.5 * p95 THEN ['slow'] ELSE ['ok'] END AS labels FROM f, p)"""


@query("request_outcomes", f"WITH {_OUT} SELECT request_id, array_to_string(labels, ',') AS labels FROM o")
def _outcomes(spark, d):
    return aggregates.outcomes(calls(spark, d)).select("request_id", F.array_join("labels", ",").alias("labels"))


@query("outcome_lift", f"""WITH {_OUT}, s AS (SELECT DISTINCT request_id, component FROM calls), e AS (SELECT request_id, unnest(labels) AS label FROM o), n AS (SELECT label, count(*) AS nl FROM e GROUP BY label), k AS (SELECT component, count(*) AS nc FROM s GROUP BY component),
b AS (SELECT component, label, count(*) AS support FROM s JOIN e USING (request_id) GROUP BY ALL), a AS (SELECT count(*) AS na FROM o)
SELECT label, component, support, round(support / nl - CASE WHEN na > nl THEN (nc - support) / (na - nl) ELSE 0 END, 6) AS lift FROM b JOIN n USING (label) JOIN k USING (component), a""")
def _lift(spark, d):
    c = calls(spark, d)
    return aggregates.outcome_lift(c, aggregates.outcomes(c)).select("label", "component", "support", r("lift").alias("lift"))


@query("fault_suspects", f"""WITH {CALLS}, q AS (SELECT request_id, max(CAST(status = 'error' AS INT)) AS failed FROM calls GROUP BY request_id), s AS (SELECT DISTINCT request_id, component FROM calls),
x AS (SELECT component, CAST(sum(failed) AS BIGINT) AS failed_with, CAST(sum(1 - failed) AS BIGINT) AS passed_with FROM s JOIN q USING (request_id) GROUP BY component), f AS (SELECT sum(failed) AS runs FROM q), e AS (SELECT component, count(*) FILTER (status = 'error') AS direct_errors FROM calls GROUP BY component)
SELECT component, failed_with, passed_with, direct_errors, round(CASE WHEN runs * (failed_with + passed_with) > 0 THEN failed_with / sqrt(CAST(runs * (failed_with + passed_with) AS DOUBLE)) ELSE 0 END, 6) AS score FROM x JOIN e USING (component), f""")
def _suspects(spark, d):
    return aggregates.suspects(calls(spark, d), None).select("component", "failed_with", "passed_with", "direct_errors", r("score").alias("score"))


@query("symbol_coverage", f"""WITH {CALLS}, m AS (SELECT component, max(session_id) AS s FROM calls GROUP BY component)
SELECT component, count(*) FILTER (status <> 'error') AS ok, count(*) FILTER (status = 'error') AS errors, round(sum(duration_ms), 4) AS total_ms, count(DISTINCT request_id) AS requests, count(*) FILTER (status = 'error' AND session_id = s) AS current_errors FROM calls JOIN m USING (component) GROUP BY component""")
def _coverage(spark, d):
    return aggregates.coverage(calls(spark, d)).withColumn("total_ms", r("total_ms", 4))


@query("callers_of", f"WITH {CALLS} SELECT parent_component AS caller, count(*) AS calls, round(sum(duration_ms), 4) AS total_ms FROM calls WHERE component = 'error' AND parent_component IS NOT NULL GROUP BY ALL")
def _callers(spark, d):
    return aggregates.callers_of(calls(spark, d), "error").withColumn("total_ms", r("total_ms", 4))


@query("cache_candidates", f"""WITH {CALLS}, k AS (SELECT CASE WHEN request_id::BIGINT % 50 < 45 THEN component ELSE component || '*' END AS component, args_hash, duration_ms, result_hash FROM calls WHERE status <> 'error'),
a AS (SELECT component, args_hash, count(*) AS n, sum(duration_ms) AS ms, count(DISTINCT result_hash) AS res FROM k GROUP BY ALL), g AS (SELECT component, CAST(sum(n) AS BIGINT) AS calls, count(*) AS distinct_args, max(res) AS most_results, round(sum(CASE WHEN n > 1 THEN ms * (n - 1) / n ELSE 0 END), 4) AS reclaimable_ms FROM a GROUP BY component)
SELECT * FROM g WHERE most_results <= 1 AND calls > distinct_args""")
def _cache(spark, d):
    c = calls(spark, d).withColumn("component", F.when(F.col("request_id").cast("long") % 50 < 45, F.col("component")).otherwise(F.concat("component", F.lit("*"))))
    return aggregates.cache_candidates(c).withColumn("reclaimable_ms", r("reclaimable_ms", 4))


@query("error_clusters", f"WITH {CALLS} SELECT component, count(*) AS defects, component || '|' || string_agg(DISTINCT error_type, ',' ORDER BY error_type) AS signature FROM calls WHERE status = 'error' GROUP BY component")
def _clusters(spark, d):
    return aggregates.error_clusters(calls(spark, d)).drop("kinds")


@query("fixed_histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(23, floor((l_extendedprice - lo) / ((hi - lo) / 24))) AS INT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def _histogram(spark, d):
    return aggregates.histogram(read_table(spark, d, "lineitem"), "l_extendedprice")


@query("percentile_kinds", """WITH v AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, quantile_cont(l_extendedprice, 0.9) AS i, quantile_disc(l_extendedprice, 0.9) AS nr FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(i, 6) AS interpolated, v[1 + CAST(floor(0.9 * (len(v) - 1)) AS INT)] AS floor_index, v[1 + least(CAST(floor(len(v) * 0.9) AS INT), len(v) - 1)] AS clamped_index, nr AS nearest_rank FROM v""")
def _percentiles(spark, d):
    picks = {"floor_index": percentiles.floor_index_at(0.9), "clamped_index": percentiles.clamped_index_at(0.9), "nearest_rank": percentiles.nearest_rank_at(0.9), "after": lambda n: F.ceil(0.9 * (n - 1))}
    o = ranges.order_statistics(read_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", picks)
    part = 0.9 * (F.col("n") - 1) - F.floor(0.9 * (F.col("n") - 1))
    return o.select("l_returnflag", r(F.col("floor_index") + part * (F.col("after") - F.col("floor_index"))).alias("interpolated"), "floor_index", "clamped_index", "nearest_rank")


@query("pareto_hotspots", """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), k AS (SELECT *, sum(total) OVER () AS al, coalesce(sum(total) OVER (ORDER BY total DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY total DESC, o_custkey) AS n FROM t)
SELECT o_custkey, round(total, 2) AS total, round(total / al, 6) AS share FROM k WHERE n <= 200 AND before < 0.2 * al""")
def _pareto(spark, d):
    t = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return lifecycle.pareto_head(t, "total", "o_custkey", 0.2, 200).select("o_custkey", r("total", 2).alias("total"), r("share").alias("share"))


@query("latest_session_rows", f"WITH {CALLS}, k AS (SELECT *, rank() OVER (PARTITION BY component ORDER BY session_id DESC) AS n FROM calls) SELECT component, session_id, count(*) AS calls FROM k WHERE n = 1 GROUP BY ALL")
def _latest(spark, d):
    c = calls(spark, d).withColumn("epoch", F.lit(None).cast("long"))
    return lifecycle.latest_session(c, ["component"], "epoch", "session_id").groupBy("component", "session_id").agg(F.count("*").alias("calls"))


@query("newest_rows", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def _newest(spark, d):
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return lifecycle.newest(o, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("monotone_breaks", "WITH k AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT user_id, event_id, round(value, 6) AS value, round(previous, 6) AS previous FROM k WHERE value <= previous")
def _monotone(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", "value")
    return lifecycle.monotone_breaks(e, "user_id", "value", "event_id").withColumn("value", r("value")).withColumn("previous", r("previous"))


@query("decayed_history", """WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS age, CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders)
SELECT o_custkey, o_orderkey, CAST(age AS INT) AS age FROM k WHERE age = 0 OR u < pow(0.5, age)""")
def _decayed(spark, d):
    return lifecycle.decayed_history(read_table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", F.col("o_orderkey").cast("string"))


@query("table_diff", """WITH b AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0), a AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a ON a.p_partkey = b.p_partkey""")
def _diff(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_size")
    after = p.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return lifecycle.table_diff(p.where("p_partkey % 7 <> 0"), after, "p_partkey", "p_size")


_EDGES = f"{CALLS}, d AS (SELECT parent_component AS src, component AS dst, count(*) AS weight FROM calls WHERE parent_component IS NOT NULL GROUP BY ALL)"


def _static(e):
    return e.where(F.col("src") < F.col("dst")).select("src", "dst").union(e.where("src = dst").select("src", F.concat("dst", F.lit("2")).alias("dst")))


@query("edge_diff", f"""WITH {_EDGES}, s AS (SELECT src, dst FROM d WHERE src < dst UNION SELECT src, dst || '2' FROM d WHERE src = dst)
SELECT coalesce(d.src, s.src) AS src, coalesce(d.dst, s.dst) AS dst, coalesce(weight, 0) AS weight, CASE WHEN s.src IS NULL THEN 'dynamic' WHEN d.src IS NULL THEN 'static' ELSE 'both' END AS found FROM d FULL JOIN s ON d.src = s.src AND d.dst = s.dst""")
def _edge_diff(spark, d):
    e = aggregates.dependency_edges(calls(spark, d), 1)
    return graph.edge_diff(e, _static(e))


@query("observed_only_edges", f"WITH {_EDGES}, s AS (SELECT DISTINCT src, dst FROM d WHERE src < dst) SELECT src, dst, weight, NOT EXISTS (SELECT 1 FROM s WHERE (s.src = d.src AND s.dst = d.dst) OR (s.src = d.dst AND s.dst = d.src)) AS observed_only FROM d")
def _flow(spark, d):
    e = aggregates.dependency_edges(calls(spark, d), 1)
    return graph.flow_flags(e, e.where("src < dst"))


@query("component_jaccard", f"""WITH {CALLS}, s AS (SELECT DISTINCT request_id, component FROM calls), n AS (SELECT component, count(*) AS n FROM s GROUP BY 1), b AS (SELECT a.component, c.component AS other, count(*) AS k FROM s a JOIN s c ON a.request_id = c.request_id AND a.component < c.component GROUP BY ALL)
SELECT b.component, other, round(k / (n.n + m.n - k), 6) AS jaccard FROM b JOIN n ON n.component = b.component JOIN n m ON m.component = other""")
def _jaccard(spark, d):
    return graph.cooccurrence(calls(spark, d).select("request_id", "component").distinct()).withColumn("jaccard", r("jaccard"))


_SUPPLY = "e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"


def _supply(spark, d):
    """Orders to parts to suppliers, of all line items."""
    li = read_table(spark, d, "lineitem")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return li.select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst")).union(li.select(node("p", "l_partkey"), node("s", "l_suppkey"))).distinct()


@query("blast_radius", f"""WITH RECURSIVE {_SUPPLY}, dn AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT e.dst, dn.depth + 1 FROM dn JOIN e ON e.src = dn.id WHERE dn.depth < 6), up AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT e.src, up.depth + 1 FROM up JOIN e ON e.dst = up.id WHERE up.depth < 6)
SELECT 'down' AS direction, id, min(depth) AS depth FROM dn GROUP BY id HAVING min(depth) > 0 UNION ALL SELECT 'up', id, min(depth) FROM up GROUP BY id HAVING min(depth) > 0""")
def _blast(spark, d):
    return graph.blast_radius(_supply(spark, d), "p1", 6)


_STEPS = "".join(f""", f{k} AS MATERIALIZED (SELECT l.dst AS id, sum(r.rank * l.share) AS flow FROM l JOIN r{k} r ON r.id = l.src GROUP BY 1), r{k + 1} AS MATERIALIZED (SELECT b.id, b.dangling, 0.15 / c.n + 0.85 * (coalesce(f.flow, 0) + x.lost / c.n) AS rank FROM b LEFT JOIN f{k} f USING (id), c, (SELECT coalesce(sum(rank) FILTER (dangling), 0) AS lost FROM r{k}) x)""" for k in range(40))


@query("pagerank_supply", f"""WITH {_SUPPLY}, n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS MATERIALIZED (SELECT count(*) AS n FROM n), g AS MATERIALIZED (SELECT src, count(*) AS degree FROM e GROUP BY 1), l AS MATERIALIZED (SELECT e.src, dst, 1.0 / CAST(degree AS DOUBLE) AS share FROM e JOIN g USING (src)),
b AS MATERIALIZED (SELECT n.id, g.src IS NULL AS dangling FROM n LEFT JOIN g ON g.src = n.id), r0 AS MATERIALIZED (SELECT b.id, b.dangling, 1.0 / CAST(c.n AS DOUBLE) AS rank FROM b, c){_STEPS} SELECT id, round(rank / (SELECT max(rank) FROM r40), 6) AS rank FROM r40""")
def _pagerank(spark, d):
    e = _supply(spark, d)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.pagerank(nodes, e).withColumn("rank", r("rank"))


@query("bm25_parts", """WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z]+|[0-9]+')) AS term FROM part), i AS (SELECT term, p_partkey, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT p_partkey, count(*) AS len FROM t GROUP BY 1), n AS (SELECT count(*) AS n, avg(len) AS m FROM l),
q AS (SELECT DISTINCT unnest(['brand', '12', 'part', '7']) AS term), df AS (SELECT term, count(*) AS df FROM i JOIN q USING (term) GROUP BY 1)
SELECT p_partkey, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))), 6) AS score FROM i JOIN df USING (term) JOIN l USING (p_partkey), n GROUP BY p_partkey""")
def _bm25(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("text"))
    return retrieval.bm25_search(p, "brand 12 part 7").select(F.col("doc_id").alias("p_partkey"), r("score").alias("score"))


@query("bm25_documents", r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([^0-9])([0-9])', '\1 \2', 'g'), '([0-9])([^0-9])', '\1 \2', 'g'), 'İ', 'i', 'g')), '[\p{L}\p{M}\p{N}]+') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d), h AS (SELECT doc_id, len(t) AS len, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (VALUES ('license'), ('version'), ('token')) q(term)), f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))), 6) AS score FROM h JOIN f USING (term), n WHERE tf > 0 GROUP BY 1""")
def _bm25_documents(spark, d):
    p = read_table(spark, d, "documents").select("doc_id", "text")
    return retrieval.bm25_search(p, "license version token").withColumn("score", r("score"))


@query("cosine_top_k", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))), 6) AS score FROM embeddings, q ORDER BY 2 DESC, vec_id LIMIT 20")
def _cosine(spark, d):
    v = read_table(spark, d, "embeddings")
    first = v.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.cosine(v, first).withColumn("score", r("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query("psi_drift", f"""WITH {HALVES}, b AS (SELECT metric, min(value) AS lo, max(value) AS hi, greatest(1, least(10, floor(count(value) / 2))) AS n FROM r GROUP BY 1), g AS (SELECT metric, unnest(range(CAST(n AS BIGINT))) AS bin FROM b),
x AS (SELECT metric, least(floor((value - lo) / ((hi - lo) / n)), n - 1) AS bin, count(*) AS k FROM r JOIN b USING (metric) GROUP BY ALL), y AS (SELECT metric, least(floor((value - lo) / ((hi - lo) / n)), n - 1) AS bin, count(*) AS k FROM c JOIN b USING (metric) WHERE value BETWEEN lo AND hi GROUP BY ALL),
z AS (SELECT g.metric, greatest(coalesce(x.k, 0) / sum(coalesce(x.k, 0)) OVER (PARTITION BY g.metric), 1e-12) AS p, greatest(coalesce(y.k, 0) / sum(coalesce(y.k, 0)) OVER (PARTITION BY g.metric), 1e-12) AS q FROM g LEFT JOIN x ON x.metric = g.metric AND x.bin = g.bin LEFT JOIN y ON y.metric = g.metric AND y.bin = g.bin)
SELECT metric, round(sum((q - p) * ln(q / p)), 6) AS psi FROM z GROUP BY 1""")
def _psi(spark, d):
    return statistics.psi(*halves(spark, d)).withColumn("psi", r("psi"))


@query("wasserstein_drift", f"""WITH {HALVES}, u AS (SELECT metric, value, sum(a) AS a, sum(b) AS b FROM (SELECT metric, value, 1 AS a, 0 AS b FROM r UNION ALL SELECT metric, value, 0, 1 FROM c) GROUP BY ALL),
w AS (SELECT metric, abs(sum(a) OVER k / sum(a) OVER (PARTITION BY metric) - sum(b) OVER k / sum(b) OVER (PARTITION BY metric)) * (lead(value) OVER (PARTITION BY metric ORDER BY value) - value) AS area FROM u WINDOW k AS (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT metric, round(sum(area), 6) AS wasserstein FROM w GROUP BY 1""")
def _wasserstein(spark, d):
    return statistics.wasserstein(*halves(spark, d)).withColumn("wasserstein", r("wasserstein"))


@query("theil_sen_trend", f"""WITH {CALLS}, s AS (SELECT component, session_id, sum(duration_ms) AS y FROM calls GROUP BY ALL), i AS (SELECT component, row_number() OVER (PARTITION BY component ORDER BY session_id) AS i, y FROM s)
SELECT a.component, round(median((b.y - a.y) / (b.i - a.i)), 5) AS slope, count(*) AS pairs FROM i a JOIN i b ON a.component = b.component AND a.i < b.i GROUP BY 1""")
def _theil(spark, d):
    s = calls(spark, d).groupBy("component", "session_id").agg(F.sum("duration_ms").alias("ms"))
    return statistics.theil_sen(s, "component", "session_id", "ms").withColumn("slope", r("slope", 5))


@query("benjamini_hochberg", """WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS component, (p_partkey * 7919 % 1009 + 1) / 1010.0 AS p FROM part), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, component) AS raw FROM t)
SELECT component, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC, component DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM k""")
def _bh(spark, d):
    t = read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("component"), ((F.col("p_partkey") * 7919 % 1009 + 1) / 1010.0).alias("p"))
    return statistics.benjamini_hochberg(t).select("component", r("p").alias("p"), r("q").alias("q"))


@query("off_policy_value", """WITH s AS (SELECT event_id AS id, event_id % 3 AS action, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END AS p, value / 100 AS reward FROM events), f AS (SELECT *, (row_number() OVER (PARTITION BY action ORDER BY sha256(CAST(id AS VARCHAR))) - 1) % 2 AS fold FROM s),
m AS (SELECT 1 - fold AS fold, action, avg(reward) AS mean FROM f GROUP BY 1, 2), z AS (SELECT reward, CASE WHEN f.action = 1 THEN 1 / p ELSE 0 END AS w, t.mean AS q, o.mean AS qa FROM f JOIN m t ON t.fold = f.fold AND t.action = 1 JOIN m o ON o.fold = f.fold AND o.action = f.action)
SELECT count(*) AS n, round(avg(q), 6) AS dm, round(avg(w * reward), 6) AS ips, round(sum(w * reward) / sum(w), 6) AS snips, round(avg(q + w * (reward - qa)), 6) AS dr, round(sum(w) * sum(w) / sum(w * w), 4) AS ess FROM z""")
def _ope(spark, d):
    e = read_table(spark, d, "events")
    a = F.col("event_id") % 3
    s = e.select(F.col("event_id").alias("decision_id"), a.cast("int").alias("action"), F.when(a == 0, 0.5).when(a == 1, 0.3).otherwise(0.2).alias("propensity"), (F.col("value") / 100).alias("reward"))
    return statistics.off_policy(s, 1).select("n", *[r(c).alias(c) for c in ("dm", "ips", "snips", "dr")], r("ess", 4).alias("ess"))


@query("learned_invariants", """WITH f AS (SELECT o_orderpriority AS endpoint, o_orderkey AS seq, 'order_id' AS field, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderkey AS DOUBLE) AS number FROM orders UNION ALL SELECT o_orderpriority, o_orderkey, 'status', o_orderstatus, NULL FROM orders),
u AS (SELECT *, number > lag(number) OVER (PARTITION BY endpoint, field ORDER BY seq) AS up FROM f), g AS (SELECT endpoint, field, count(*) AS n, count(*) - count(text) AS nulls, count(DISTINCT text) AS kinds, count(number) AS numbers, min(number) AS low, max(number) AS high, bool_and(coalesce(up, true)) AS rises FROM u GROUP BY 1, 2 HAVING count(*) >= 5),
k AS (SELECT *, unnest(['never_null', 'stable_enum', 'numeric_bound', 'id_monotonic']) AS kind FROM g), x AS (SELECT *, CASE kind WHEN 'numeric_bound' THEN 2 / (n + 1) WHEN 'stable_enum' THEN kinds / n ELSE pow(2.0, -n) END AS chance FROM k WHERE CASE kind WHEN 'never_null' THEN nulls = 0 WHEN 'stable_enum' THEN nulls = 0 AND kinds BETWEEN 2 AND 8 WHEN 'numeric_bound' THEN numbers = n AND low < high ELSE numbers = n AND rises AND field LIKE '%id' END)
SELECT endpoint, field, n, kinds, low, high, kind, (n + 1) / (n + 2) AS confidence, chance, chance <= 0.10 AS enforced FROM x""")
def _invariants(spark, d):
    o = read_table(spark, d, "orders")
    f = F.explode(F.array(F.struct(F.lit("order_id").alias("field"), F.col("o_orderkey").cast("string").alias("text"), F.col("o_orderkey").cast("double").alias("number")), F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("text"), F.lit(None).cast("double").alias("number")))).alias("x")
    return statistics.learned_invariants(o.select(F.col("o_orderpriority").alias("endpoint"), F.col("o_orderkey").alias("seq"), f).select("endpoint", "seq", "x.*"))


@query("arm_statistics", "SELECT event_type AS arm, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1")
def _arms(spark, d):
    return aggregates.arm_stats(read_table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("value").alias("reward"))).select("arm", "n", r("mean").alias("mean"), r("variance", 4).alias("variance"))


@query("failure_signatures", """SELECT substr(sha256('doc|' || substr(trim(regexp_replace(regexp_replace(lower(c_name || '  ' || c_mktsegment), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')), 1, 600)), 1, 24) AS signature, count(*) AS n, arg_min(c_name, c_custkey) AS exemplar FROM customer GROUP BY 1""")
def _signatures(spark, d):
    c = read_table(spark, d, "customer")
    return aggregates.clusters(c, text.failure_signature(F.lit("doc"), F.concat_ws("  ", "c_name", "c_mktsegment")), F.col("c_name"), F.col("c_custkey"))


@query("evidence_similarity", """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 1)) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def _similarity(spark, d):
    w = read_table(spark, d, "benchmark").select("item_id", text.evidence_words(F.col("text")).alias("w"))
    b = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return w.join(b, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), r(text.jaccard(F.col("w"), F.col("v"))).alias("similarity"))


@query("token_estimates", "SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def _estimates(spark, d):
    return read_table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("status_classes", "SELECT CASE WHEN s IS NULL THEN 'no-response' WHEN s >= 500 THEN '5xx' WHEN s >= 400 THEN '4xx' ELSE 'ok' END AS class, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE 200 + 100 * (event_id % 4) END AS s FROM events) GROUP BY 1")
def _classes(spark, d):
    s = F.when(F.col("event_id") % 9 != 0, 200 + 100 * (F.col("event_id") % 4))
    return read_table(spark, d, "events").groupBy(predicates.status_class(s).alias("class")).agg(F.count("*").alias("n"))


_LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS request_id, user_id % 3 AS thread_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_type AS component, CASE WHEN event_id % 5 < 3 THEN 'enter' ELSE 'exit' END AS event FROM events)"""
_FOREST = f"""{_LOG}, v AS (SELECT *, sum(CASE WHEN event = 'enter' THEN 1 ELSE -1 END) OVER (PARTITION BY request_id, thread_id ORDER BY seq) AS up FROM log), w AS (SELECT *, CASE WHEN event = 'enter' THEN up ELSE up + 1 END AS level FROM v),
x AS (SELECT *, lead(event) OVER k AS next_event, lead(seq) OVER k AS next_seq, lead(ts) OVER k AS next_ts FROM w WINDOW k AS (PARTITION BY request_id, thread_id, level ORDER BY seq)),
y AS (SELECT request_id, thread_id, seq, ts, component, level, CASE WHEN next_event = 'exit' THEN next_seq END AS exit_seq, CASE WHEN next_event = 'exit' THEN next_ts END AS exit_ts FROM x WHERE event = 'enter'),
forest AS (SELECT y.*, (SELECT max(p.seq) FROM y p WHERE p.request_id = y.request_id AND p.thread_id = y.thread_id AND p.level = y.level - 1 AND p.seq < y.seq) AS parent_seq, level - min(level) OVER (PARTITION BY request_id, thread_id) AS depth FROM y)"""


def _forest(spark, d):
    e = read_table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return spans.call_forest(e.select(F.col("user_id").cast("string").alias("request_id"), (F.col("user_id") % 3).alias("thread_id"), seq.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("component"), F.when(F.col("event_id") % 5 < 3, "enter").otherwise("exit").alias("event")))


@query("call_forest", f"WITH {_FOREST} SELECT request_id, seq, component, exit_seq, parent_seq, CAST(depth AS BIGINT) AS depth FROM forest")
def _call_forest(spark, d):
    return _forest(spark, d).select("request_id", "seq", "component", "exit_seq", "parent_seq", F.col("depth").cast("long").alias("depth"))


@query("self_times", f"""WITH {_FOREST}, c AS (SELECT *, date_diff('microsecond', ts, exit_ts) / 1000.0 AS ms FROM forest WHERE exit_seq IS NOT NULL), k AS (SELECT request_id, thread_id, parent_seq AS seq, sum(ms) AS inner_ms FROM c GROUP BY ALL)
SELECT component, count(*) AS calls, round(sum(ms), 3) AS total_ms, round(sum(greatest(ms - coalesce(inner_ms, 0), 0)), 3) AS self_ms FROM c LEFT JOIN k USING (request_id, thread_id, seq) GROUP BY 1""")
def _self_times(spark, d):
    return spans.self_times(_forest(spark, d)).select("component", "calls", r("total_ms", 3).alias("total_ms"), r("self_ms", 3).alias("self_ms"))


@query("repeated_children", f"""WITH {_FOREST}, k AS (SELECT request_id, thread_id, parent_seq AS seq, component AS child, count(*) AS n FROM forest WHERE parent_seq IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT f.component, child, count(*) AS callers, CAST(sum(n) AS BIGINT) AS calls FROM k JOIN forest f USING (request_id, thread_id, seq) GROUP BY ALL""")
def _repeated(spark, d):
    return spans.repeated_children(_forest(spark, d))


@query("redacted_documents", r"""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+', '\1 ***', 'g'), '(?i)\b([A-Za-z0-9_-]*(?:password|passwd|secret|token|api[_-]?key|authorization)["'']?\s*[=:]\s*)("[^"]*"|''[^'']*''|(?:bearer|basic)\s+[^\s,;&"''}]+|[^\s,;&"''}]+)', '\1***', 'g'),
'\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*', '***', 'g'), '([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s:]+:[^/@\s]+@', '\1***@', 'g')) AS n_chars FROM documents""")
def _redacted(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.length(text.redacted(F.col("text"))).cast("long").alias("n_chars"))


_PATH = "CASE c_custkey % 7 WHEN 0 THEN 'src/tests/' || c_name || '.py' WHEN 1 THEN 'Src\\Testing\\' || c_name WHEN 2 THEN 'spec/' || c_name || '.rs' WHEN 3 THEN 'app/test_' || c_name WHEN 4 THEN 'app/' || c_name || '_test.go' WHEN 5 THEN 'web/' || c_name || '.spec.ts' ELSE 'conftest.py' END"


@query("test_paths", f"""SELECT c_custkey, regexp_matches(replace(lower({_PATH}), '\\', '/'), '(^|/)(tests?|__tests__|testing)/') OR regexp_matches(replace(lower({_PATH}), '\\', '/'), '(^|/)(test_[^/]*|[^/.]*_test(\\.[^/]*)?|[^/]*\\.(test|spec)\\.[^/]*)$') AS is_test FROM customer""")
def _test_paths(spark, d):
    path = F.expr(_PATH.replace("\\", "\\\\"))
    return read_table(spark, d, "customer").select("c_custkey", predicates.is_test_path(path).alias("is_test"))


@query("reciprocal_ranks", "SELECT p_partkey, rank, round(1 / (60 + rank), 6) AS weight FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 200")
def _ranks(spark, d):
    return retrieval.rrf(read_table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("score")), "p_partkey").select("p_partkey", "rank", r("weight").alias("weight"))
