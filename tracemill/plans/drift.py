"""Queries of the drift operators over an hourly rollup of all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, shapes
from ..registry import query
from ..sources.tables import read_table
from .queries import r

_BASE, _WINDOW = "2024-01-01,2024-01-15", "2024-01-15,2024-01-31"
_MEASURES = ["count(CASE WHEN value > 100 THEN 1 END) AS error_count", "avg(value) AS latency_p50", "max(value) AS latency_p95", "min(value) AS latency_p99", "count(*) / 3600 AS qps", "5.0 * count(*) / count(*) AS max_call_count_per_request"]
_ROLLUP = f"m AS (SELECT date_trunc('hour', ts) AS bucket, event_type AS component, {', '.join(_MEASURES)} FROM events GROUP BY 1, 2)"
_NAMES = [x.rsplit(" AS ", 1)[1] for x in _MEASURES]
_SLOT = "CASE WHEN value BETWEEN {lo} AND {hi} THEN (SELECT max(i) FROM range(CAST({n} AS BIGINT)) t(i) WHERE i = 0 OR value >= {lo} + i * (({hi} - {lo}) / {n})) END"
_REPORT = f"""{_ROLLUP}, u AS (UNPIVOT (SELECT bucket, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _NAMES)} FROM m) ON {', '.join(_NAMES)} INTO NAME metric VALUE value),
v AS (SELECT metric, value, true AS base FROM u WHERE bucket BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-15' UNION ALL SELECT metric, value, false FROM u WHERE bucket BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-31'),
f0 AS (SELECT metric, count(*) FILTER (base) AS n_baseline, count(*) FILTER (NOT base) AS n_window, min(value) FILTER (base) AS l, max(value) FILTER (base) AS h, min(value) AS al, max(value) AS ah FROM v GROUP BY 1),
f AS (SELECT *, CASE WHEN l = h THEN l - 0.5 ELSE l END AS lo, CASE WHEN l = h THEN h + 0.5 ELSE h END AS hi, least(10, greatest(2, n_baseline // 2)) AS n, least(12, greatest(3, floor(sqrt(n_baseline)) + 2)) - 1 AS k FROM f0),
x AS (SELECT v.metric, base, {_SLOT.format(lo='lo', hi='hi', n='n')} AS s, CASE WHEN al < ah THEN {_SLOT.format(lo='al', hi='ah', n='k')} END AS t FROM v JOIN f USING (metric)),
g AS (SELECT metric, s, count(*) FILTER (base) AS r, count(*) FILTER (NOT base) AS c FROM x WHERE s IS NOT NULL GROUP BY 1, 2), a AS (SELECT f.metric, i, coalesce(r, 0) / sum(coalesce(r, 0)) OVER w AS p, coalesce(c, 0) / greatest(1, sum(coalesce(c, 0)) OVER w) AS q FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS i FROM f) f LEFT JOIN g ON g.metric = f.metric AND g.s = i WINDOW w AS (PARTITION BY f.metric)),
e AS (SELECT *, (p + 1e-12) / sum(p + 1e-12) OVER w AS pe, (q + 1e-12) / sum(q + 1e-12) OVER w AS qe FROM a WINDOW w AS (PARTITION BY metric)), d1 AS (SELECT metric, sum((q - p) * ln((q + 1e-12) / (p + 1e-12))) AS psi, sum(pe * ln(pe / qe)) AS entropy_divergence FROM e GROUP BY 1),
h AS (SELECT metric, t, count(*) FILTER (base) AS r, count(*) FILTER (NOT base) AS c FROM x WHERE t IS NOT NULL GROUP BY 1, 2), b AS (SELECT f.metric, coalesce(r, 0) / sum(coalesce(r, 0)) OVER w / ((ah - al) / k) + 1e-12 AS p, coalesce(c, 0) / sum(coalesce(c, 0)) OVER w / ((ah - al) / k) + 1e-12 AS q FROM (SELECT *, unnest(range(CAST(k AS BIGINT))) AS i FROM f WHERE al < ah) f LEFT JOIN h ON h.metric = f.metric AND h.t = i WINDOW w AS (PARTITION BY f.metric)),
d2 AS (SELECT metric, sum(p * ln(p / q)) AS kl FROM (SELECT metric, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM b WINDOW w AS (PARTITION BY metric)) GROUP BY 1),
y AS (SELECT metric, value, count(*) FILTER (base) AS r, count(*) FILTER (NOT base) AS c FROM v GROUP BY 1, 2), d3 AS (SELECT metric, coalesce(sum(area), 0) AS wasserstein FROM (SELECT metric, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY metric) - sum(c) OVER w / sum(c) OVER (PARTITION BY metric)) * (lead(value) OVER (PARTITION BY metric ORDER BY value) - value) AS area FROM y WINDOW w AS (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1)"""


def _rollup(spark, d):
    return read_table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("bucket"), F.col("event_type").alias("component")).agg(*[F.expr(x.rsplit(" AS ", 1)[0]).alias(n) for x, n in zip(_MEASURES, _NAMES, strict=True)])


@query("drift_report", f"WITH {_REPORT} SELECT metric, round(psi, 6) AS psi, round(coalesce(kl, 0), 6) AS kl_histogram, round(entropy_divergence, 6) AS entropy_divergence, round(wasserstein, 6) AS wasserstein, n_baseline, n_window FROM f JOIN d1 USING (metric) LEFT JOIN d2 USING (metric) JOIN d3 USING (metric)")
def _report(spark, d):
    o = drift.drift_report(_rollup(spark, d), _BASE, _WINDOW)
    return o.select("metric", *[r(c).alias(c) for c in ("psi", "kl_histogram", "entropy_divergence", "wasserstein")], "n_baseline", "n_window")


_CHAIN = [("view", "click"), ("click", "signup"), ("signup", "error"), ("error", "purchase"), ("purchase", "view"), ("nobody", "view")]
_CAUSES = f"""{_ROLLUP}, s AS (SELECT bucket, component, latency_p50 AS y, bucket >= TIMESTAMP '2024-01-16' AS bad FROM m), e(src, dst) AS (VALUES {', '.join(map(str, _CHAIN))}),
j AS (SELECT c.component, c.bad, c.bucket, c.y, p.y AS x, row_number() OVER (PARTITION BY c.component, c.bad ORDER BY c.bucket) AS k, count(*) OVER (PARTITION BY c.component, c.bad) AS n FROM s c JOIN e ON dst = c.component JOIN s p ON p.component = src AND p.bucket = c.bucket),
l AS (SELECT component, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM j WHERE NOT bad AND k <= greatest(20, floor(n * 2 / 3.0)) GROUP BY 1), z AS (SELECT component, bad, y - a - b * x AS res FROM j JOIN l USING (component) WHERE bad OR k > greatest(20, floor(n * 2 / 3.0))),
t AS (SELECT component, res, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER w / sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY component) - sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER w / sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY component) AS gap FROM z WINDOW w AS (PARTITION BY component ORDER BY res))"""


@query("root_causes", f"WITH {_CAUSES} SELECT component, round(max(abs(gap)), 6) AS ks, (SELECT round(avg(res) FILTER (bad) - avg(res) FILTER (NOT bad), 6) FROM z WHERE z.component = t.component) AS shift, (SELECT count(*) FILTER (NOT bad) FROM z WHERE z.component = t.component) AS n_normal, (SELECT count(*) FILTER (bad) FROM z WHERE z.component = t.component) AS n_incident FROM t GROUP BY 1")
def _causes(spark, d):
    rows = _rollup(spark, d).select("bucket", "component", F.col("latency_p50").alias("value"))
    o = drift.root_causes(rows, spark.createDataFrame(_CHAIN, "src string, dst string"), "2024-01-01,2024-01-15 23:59:59", "2024-01-16,2024-02-28")
    return o.select("component", r("ks").alias("ks"), r("shift").alias("shift"), "n_normal", "n_incident")


_BODY = """CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN props WHEN 2 THEN concat('{"ok": ', event_id % 2 = 0, ', "items": [', props, ', ', event_id, ', ', props, ']}') WHEN 3 THEN concat('text ', props) ELSE CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[1]' ELSE '[1, 2.5, -3e9]' END END"""


@query("response_shapes", """WITH s AS (SELECT CASE event_id % 5 WHEN 0 THEN 'empty' WHEN 3 THEN 'raw:text/plain' ELSE 'json:' || substr(sha256(CASE event_id % 5 WHEN 1 THEN '{k:number}' WHEN 2 THEN '{items:[number|{k:number}],ok:boolean}' ELSE CASE event_id % 3 WHEN 0 THEN '[]' ELSE '[number]' END END), 1, 16) END AS shape FROM events) SELECT shape, count(*) AS n FROM s GROUP BY 1""")
def _shapes(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_id").alias("key"), F.expr(_BODY).alias("body"), F.lit("text/plain; charset=utf-8").alias("content_type"))
    return shapes.shape_hashes(e).groupBy("shape").agg(F.count("*").alias("n"))
