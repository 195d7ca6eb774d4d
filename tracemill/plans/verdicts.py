"""Queries of the verdict operators. Observations are made from the test tables by expressions that Spark and the checking SQL read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verdicts
from ..registry import query
from ..sources.tables import read_table

_NOW = ["o_orderkey AS probe_id", "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 500 WHEN 2 THEN 404 ELSE 200 END AS status", "o_orderkey % 3 AS shape", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 2 END AS digest", "o_orderkey % 4 < 2 AS stable"]
_THEN = ["o_orderkey AS probe_id", "CASE o_custkey % 4 WHEN 0 THEN 503 WHEN 1 THEN 403 ELSE 201 END AS status", "o_custkey % 3 AS shape", "CASE WHEN o_custkey % 5 > 1 THEN o_orderkey % 2 END AS digest"]


@query("baseline_verdicts", f"""WITH o AS (SELECT {', '.join(_NOW)} FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT {', '.join(_THEN)} FROM orders WHERE o_orderpriority <> '1-URGENT'),
g AS (SELECT * FROM (VALUES ('none', 0), ('5', 1), ('4', 2), ('2', 3)) AS t(c, g)), x AS (SELECT o.*, g FROM o JOIN g ON c = CASE WHEN status IS NULL THEN 'none' WHEN status >= 500 THEN '5' WHEN status >= 400 THEN '4' ELSE '2' END), y AS (SELECT b.*, g FROM b JOIN g ON c = CASE WHEN status >= 500 THEN '5' WHEN status >= 400 THEN '4' ELSE '2' END),
v AS (SELECT x.*, 'recorded' AS verdict FROM x ANTI JOIN y USING (probe_id) WHERE g = 3 UNION ALL SELECT x.*, NULL FROM x ANTI JOIN y USING (probe_id) WHERE g < 3
 UNION ALL SELECT x.*, CASE WHEN x.g > y.g THEN 'improved' WHEN x.g < y.g OR (x.g = 3 AND (x.shape <> y.shape OR x.digest <> y.digest)) THEN 'degraded' ELSE 'same' END FROM x JOIN y USING (probe_id)),
z AS (SELECT probe_id, verdict, status, shape, CASE WHEN stable THEN digest END AS digest FROM v WHERE verdict IN ('recorded', 'improved') UNION ALL SELECT probe_id, NULL, y.status, y.shape, y.digest FROM y ANTI JOIN v USING (probe_id)
 UNION ALL SELECT probe_id, verdict, y.status, y.shape, CASE WHEN verdict = 'same' AND y.digest IS NULL AND stable THEN v.digest ELSE y.digest END FROM v JOIN y USING (probe_id) WHERE verdict IN ('same', 'degraded') UNION ALL SELECT probe_id, NULL, NULL, NULL, NULL FROM v WHERE verdict IS NULL)
SELECT probe_id, verdict, CAST(status AS BIGINT) AS entry_status, CAST(shape AS BIGINT) AS entry_shape, CAST(digest AS BIGINT) AS entry_digest FROM z""")
def _baseline(spark, d):
    o = read_table(spark, d, "orders")
    out = verdicts.against_baseline(o.where("o_orderpriority <> '5-LOW'").selectExpr(*_NOW), o.where("o_orderpriority <> '1-URGENT'").selectExpr(*_THEN))
    return out.select("probe_id", "verdict", *[F.col(c).cast("long").alias(c) for c in ("entry_status", "entry_shape", "entry_digest")])


@query("replay_differences", """WITH s AS (SELECT o_orderkey, o_totalprice, CASE o_custkey % 4 WHEN 0 THEN 503 WHEN 1 THEN 403 ELSE 201 END AS e, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 500 WHEN 2 THEN 404 ELSE 200 END AS s, o_custkey % 2 AS es, o_orderkey % 2 AS ss, o_totalprice / 100000 AS p, o_custkey % 7 AS m FROM orders)
SELECT o_orderkey, CASE WHEN s IS NULL OR e // 100 <> s // 100 THEN 'behavior' WHEN e = 201 AND es <> ss THEN 'contract' WHEN p > 1 AND m > 2 * p THEN 'perf' END AS difference FROM s""")
def _replay(spark, d):
    o = read_table(spark, d, "orders")
    now, then = o.selectExpr("o_orderkey", "o_custkey", "o_totalprice", _NOW[1]), F.expr(_THEN[1].removesuffix(" AS status"))
    return now.select("o_orderkey", verdicts.replay_difference(then, F.col("status"), F.col("o_custkey") % 2, F.col("o_orderkey") % 2, F.col("o_totalprice") / 100000, F.col("o_custkey") % 7).alias("difference"))


_COMPARED = ["p_partkey", "p_brand AS target", "p_partkey % 3 <> 0 AS ref_ok", "CASE WHEN p_partkey % 4 = 0 THEN 'obj at 0xAB1' ELSE p_brand END AS ref_value", "CASE WHEN p_partkey % 9 = 0 THEN 'TypeError' ELSE 'ValueError' END AS ref_exception", "p_size % 3 <> 0 AS got_ok",
    "CASE WHEN p_partkey % 4 = 0 THEN 'obj at 0xcd' WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS got_value", "CASE WHEN p_size % 2 = 0 THEN 'RuntimeError' ELSE 'ValueError' END AS got_exception", "CASE WHEN p_size % 5 = 0 THEN 'due to TypeError' ELSE 'refused' END AS got_message",
    "CASE p_size % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'defect' END AS adjudication"]


@query("reference_verdicts", f"""WITH c AS (SELECT {', '.join(_COMPARED)} FROM part), r AS (SELECT *, CASE adjudication WHEN 'policy' THEN 1 WHEN 'defect' THEN 2 ELSE 0 END AS a FROM c)
SELECT p_partkey, CASE WHEN ref_ok AND got_ok AND regexp_replace(ref_value, ' at 0x[0-9a-fA-F]+', '', 'g') <> regexp_replace(got_value, ' at 0x[0-9a-fA-F]+', '', 'g') THEN 'wrong-value' WHEN got_ok AND NOT ref_ok THEN 'accepts-invalid'
WHEN NOT got_ok AND (ref_ok OR (got_exception <> ref_exception AND position(ref_exception IN got_message) = 0)) THEN CASE a WHEN 1 THEN 'policy-limit' WHEN 0 THEN 'unadjudicated' ELSE CASE WHEN ref_ok THEN 'rejects-valid' ELSE 'wrong-exception' END END END AS verdict FROM r""")
def _reference(spark, d):
    rows = read_table(spark, d, "part").selectExpr(*_COMPARED)
    return rows.select("p_partkey", verdicts.reference_verdict(rows).alias("verdict"))


@query("implausible_targets", f"""WITH c AS (SELECT {', '.join(_COMPARED)} FROM part) SELECT target, count(*) FILTER (ref_ok AND got_ok) AS answered, count(*) FILTER (ref_ok AND got_ok AND ref_value <> got_value) AS differing FROM c GROUP BY target HAVING count(*) >= 20 AND answered > 0 AND differing >= 0.6 * answered""")
def _implausible(spark, d):
    return verdicts.implausible_targets(read_table(spark, d, "part").selectExpr(*_COMPARED), share=0.6)


_CALLED = ["user_id AS target", "CASE event_id % 4 WHEN 0 THEN 'serial' WHEN 1 THEN 'serial-control' ELSE 'concurrent' END AS phase", "event_id % 4 AS batch", "event_type <> 'error' AS ok", "CAST(floor(value) AS BIGINT) % 3 AS value", "CASE WHEN event_id % 8 < 5 THEN 'KeyError' ELSE 'Race' END AS exception", "event_id % 97 = 3 AS timed_out"]


@query("concurrency_findings", f"""WITH e AS (SELECT {', '.join(_CALLED)} FROM events), p AS (SELECT target, phase, batch, count(*) AS calls, count(*) FILTER (timed_out) AS late, count(*) FILTER (ok) AS ok, count(DISTINCT value) FILTER (ok) AS d, coalesce(list(DISTINCT exception) FILTER (NOT ok), []) AS f FROM e GROUP BY ALL),
j AS (SELECT c.*, s.d AS sd, s.f AS sf, k.d AS kd FROM p c JOIN p s ON s.target = c.target AND s.phase = 'serial' LEFT JOIN p k ON k.target = c.target AND k.phase = 'serial-control' WHERE c.phase = 'concurrent')
SELECT DISTINCT target, 'hang' AS kind, late || '/' || calls AS detail FROM j WHERE late > 0 UNION ALL SELECT DISTINCT target, 'lost-update', d || '/' || sd FROM j WHERE late = 0 AND ok > 0 AND d < sd AND (kd IS NULL OR kd = sd)
UNION ALL SELECT DISTINCT target, 'new-exceptions', array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(sf, x))), ',') FROM j WHERE late = 0 AND len(list_filter(f, lambda x: NOT list_contains(sf, x))) > 0""")
def _concurrency(spark, d):
    return verdicts.concurrency_findings(verdicts.batch_profiles(read_table(spark, d, "events").selectExpr(*_CALLED)))


_FAULT = ["CASE o_orderkey % 5 WHEN 0 THEN 'chunk-sweep' WHEN 1 THEN 'chunk-convergence' WHEN 2 THEN 'import' ELSE 'run' END AS phase", "CASE WHEN o_custkey % 3 > 0 THEN 'error' ELSE 'ok' END AS status", "CASE o_orderstatus WHEN 'F' THEN 'ValueError' WHEN 'O' THEN 'KeyError' END AS error_type", "CASE WHEN o_custkey % 7 > 2 THEN o_custkey % 2 = 0 END AS divergent"]


@query("fault_verdicts", f"""WITH f AS (SELECT {', '.join(_FAULT)} FROM orders), v AS (SELECT CASE WHEN status = 'ok' THEN NULL WHEN phase = 'import' THEN 'import-error' WHEN phase = 'chunk-convergence' OR phase = 'chunk-sweep' AND divergent THEN 'fault-divergence' WHEN error_type = 'ValueError' THEN NULL ELSE 'fault-crash' END AS verdict FROM f) SELECT verdict, count(*) AS n FROM v GROUP BY 1""")
def _faults(spark, d):
    f = read_table(spark, d, "orders").selectExpr(*_FAULT)
    return f.groupBy(verdicts.fault_verdict(*map(F.col, ("phase", "status", "error_type", "divergent"))).alias("verdict")).agg(F.count("*").alias("n"))
