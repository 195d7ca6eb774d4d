"""Queries of the trace operators: each event is a call of a request, logged when it ended; some exits are lost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces
from ..registry import query
from ..sources.tables import read_table
from .queries import r

_CALL = [
    "date_trunc('month', ts) AS session_id", "user_id % 20 AS request_id", "user_id % 3 AS thread_id", "event_id", "event_type AS component", "event_id % 3 AS depth",
    "CASE event_id * 7 % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' WHEN 3 THEN 'error' ELSE 'purchase' END AS parent_component", "value * 600000 / (1 + event_id % 3) AS duration_ms",
    "event_type = 'error' AND event_id % 2 = 0 AS errored", "event_id % 4 < 2 AS io",
]
_SPANS = f"""sp AS (SELECT *, 2 * event_id AS seq, 2 * event_id + 1 AS exit_seq, CASE WHEN event_id % 5 = 0 THEN duration_ms / 3 ELSE 0 END AS blocked_ms FROM (SELECT {', '.join(_CALL)}, epoch_us(ts) / 1000.0 AS start_ms FROM events) WHERE event_id % 41 <> 0),
t AS (SELECT *, (SELECT arg_max(p.seq, (p.start_ms, p.exit_seq)) FROM sp p WHERE p.session_id = c.session_id AND p.request_id = c.request_id AND p.depth = c.depth - 1 AND p.component = c.parent_component AND p.start_ms <= c.start_ms AND p.start_ms + p.duration_ms + 1.5 >= c.start_ms) AS parent_seq FROM sp c)"""
_SIGNALS = f"""{_SPANS}, ch AS (SELECT request_id, parent_seq AS seq, sum(duration_ms) AS inner_ms FROM t WHERE parent_seq IS NOT NULL GROUP BY ALL),
own AS (SELECT t.*, greatest(duration_ms - coalesce(inner_ms, 0), 0) AS own_ms FROM t LEFT JOIN ch USING (request_id, seq)),
b AS (SELECT component, sum(own_ms) AS self_ms, sum(duration_ms) AS wall_ms, sum(blocked_ms) AS blocked_ms FROM own WHERE NOT errored GROUP BY 1),
n AS (SELECT c.component, p.component AS caller, count(*) AS n, sum(c.duration_ms) AS ms FROM t c JOIN t p ON p.request_id = c.request_id AND p.seq = c.parent_seq WHERE NOT c.errored GROUP BY c.component, p.component, p.request_id, p.seq HAVING count(*) >= 4),
n1 AS (SELECT component, sum(ms * (n - 1) / n) AS n_plus_one_ms, max(n) AS n_count FROM n GROUP BY 1),
s AS (SELECT p.component, c.request_id, c.parent_seq, c.duration_ms, c.start_ms < lag(c.start_ms + c.duration_ms) OVER (PARTITION BY c.request_id, c.parent_seq ORDER BY c.start_ms, c.seq) - 1 AS bad FROM t c JOIN t p ON p.request_id = c.request_id AND p.seq = c.parent_seq WHERE c.io AND NOT c.errored AND c.duration_ms > 0),
s1 AS (SELECT component, sum(saved) AS serial_ms, max(n) AS serial_count FROM (SELECT component, count(*) AS n, sum(duration_ms) - max(duration_ms) AS saved FROM s GROUP BY component, request_id, parent_seq HAVING count(*) > 1 AND NOT coalesce(bool_or(bad), false)) WHERE saved > 0 GROUP BY 1),
m AS (SELECT component, median(own_ms) AS typical FROM own WHERE NOT errored AND duration_ms > 0 GROUP BY 1 HAVING count(*) >= 3), d AS (SELECT component, any_value(typical) AS typical, any_value(typical) + 1.4826 * median(abs(own_ms - typical)) AS bound FROM own JOIN m USING (component) WHERE NOT errored AND duration_ms > 0 GROUP BY 1),
w AS (SELECT component, sum(own_ms - typical) AS wait_ms, count(*) AS wait_count FROM own JOIN d USING (component) WHERE NOT errored AND NOT io AND duration_ms > 0 AND own_ms > bound GROUP BY 1),
sig AS (SELECT component, coalesce(self_ms, 0) AS self_ms, coalesce(wall_ms, 0) AS wall_ms, coalesce(blocked_ms, 0) AS blocked_ms, coalesce(n_plus_one_ms, 0) AS n_plus_one_ms, coalesce(n_count, 0) AS n_count, coalesce(serial_ms, 0) AS serial_ms, coalesce(serial_count, 0) AS serial_count, coalesce(wait_ms, 0) AS wait_ms, coalesce(wait_count, 0) AS wait_count
FROM b FULL JOIN n1 USING (component) FULL JOIN s1 USING (component) FULL JOIN w USING (component))"""


def _log(spark, d):
    e = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.selectExpr(*_CALL, "unix_micros(ts) / 1000 AS ts_ms")
    blocked = F.when(F.col("event_id") % 5 == 0, F.col("duration_ms") / 3).otherwise(0.0)
    enter = e.drop("duration_ms", "errored", "io").withColumns({"seq": F.col("event_id") * 2, "event": F.lit("enter")})
    leave = e.where("event_id % 41 <> 0").withColumns({"seq": F.col("event_id") * 2 + 1, "event": F.lit("exit"), "blocked_ms": blocked})
    return enter.unionByName(leave, allowMissingColumns=True)


def _spans(spark, d):
    return traces.enclosing_spans(traces.paired_spans(_log(spark, d)))


@query("enclosing_spans", f"WITH {_SPANS} SELECT request_id, seq, component, round(duration_ms, 3) AS duration_ms, parent_seq FROM t")
def _enclosing(spark, d):
    return _spans(spark, d).select("request_id", "seq", "component", r("duration_ms", 3).alias("duration_ms"), "parent_seq")


_ROUNDED = ["self_ms", "wall_ms", "blocked_ms", "n_plus_one_ms", "serial_ms", "wait_ms"]


@query("span_signals", f"WITH {_SIGNALS} SELECT component, n_count, serial_count, wait_count, {', '.join(f'round({c}, 3) AS {c}' for c in _ROUNDED)} FROM sig")
def _signals(spark, d):
    return traces.span_signals(_spans(spark, d)).select("component", "n_count", "serial_count", "wait_count", *[r(c, 3).alias(c) for c in _ROUNDED])


_TIMINGS = ["event_type || '.' || (event_id % 40) AS component", "strftime(ts, '%d') AS session_id", "CAST(strftime(ts, '%d') AS INT) AS day", "value AS ms", "event_id % 7 * 1000 AS bytes", "props || (event_id % 3) AS args"]
_CANDIDATES = f"""{_SIGNALS}, e AS (SELECT {', '.join(_TIMINGS)} FROM events), tm AS (SELECT component, session_id, any_value(day) AS day, count(*) AS calls, sum(ms) AS total_ms, max(day) * 0.7 AS gc_pause_ms, sum(bytes)::BIGINT AS alloc_bytes FROM e GROUP BY 1, 2),
l AS (SELECT tm.* FROM tm QUALIFY row_number() OVER (PARTITION BY component ORDER BY day DESC) = 1), g AS (SELECT component || '.0' AS component, self_ms / 1e7 AS self_ms, wall_ms / 1e7 AS wall_ms, blocked_ms / 1e7 AS blocked_ms, n_plus_one_ms / 1e7 AS n_plus_one_ms, serial_ms / 1e7 AS serial_ms, wait_ms / 1e7 AS wait_ms FROM sig),
a AS (SELECT l.*, self_ms, wall_ms, blocked_ms, n_plus_one_ms, serial_ms, wait_ms, coalesce(self_ms, total_ms) AS cost FROM l LEFT JOIN g USING (component)), ca AS (SELECT component, sum(ms * (n - 1) / n) AS reclaimable_ms FROM (SELECT component, args, count(*) AS n, sum(ms) AS ms FROM e GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
fo AS (SELECT q.component, max(p.calls) AS caller FROM l q JOIN l p ON split_part(p.component, '.', 2)::INT = (split_part(q.component, '.', 2)::INT + 1) % 40 GROUP BY 1), ty AS (SELECT median(cost / calls) AS typical FROM a WHERE cost > 0),
se AS (SELECT session_id, max(gc_pause_ms) AS pause, sum(alloc_bytes) AS allocated, median(total_ms) FILTER (total_ms > 0) AS middle FROM l GROUP BY 1), gx AS (SELECT component, alloc_bytes, session_id, coalesce(sum(alloc_bytes) OVER (PARTITION BY session_id ORDER BY alloc_bytes DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WHERE alloc_bytes > 0),
gc AS (SELECT component, pause * alloc_bytes / allocated AS gc_ms FROM gx JOIN se USING (session_id) WHERE pause > middle AND allocated > 0 AND before / allocated < 0.8),
o AS (SELECT component, total_ms, [coalesce(reclaimable_ms, 0), CASE WHEN calls > caller THEN total_ms * (1 - caller / calls) ELSE 0 END, CASE WHEN cost / calls > typical THEN cost * (1 - typical / (cost / calls)) * CASE WHEN wall_ms > 0 AND blocked_ms > 0 THEN greatest(1 - blocked_ms / wall_ms, 0) ELSE 1 END ELSE 0 END, coalesce(n_plus_one_ms, 0), coalesce(serial_ms, 0), coalesce(wait_ms, 0), coalesce(gc_ms, 0)] AS ms
FROM a LEFT JOIN ca USING (component) LEFT JOIN fo USING (component) LEFT JOIN gc USING (component), ty), k AS (SELECT component, total_ms, list_max(ms) AS top, list_position(ms, list_max(ms)) AS kind FROM o WHERE list_max(ms) > 0),
x AS (SELECT component, least(top, total_ms) AS predicted_ms, least(top / total_ms, 1) AS waste_prior, ['cache', 'fanout', 'per-call', 'n-plus-1', 'serial-async', 'wait', 'gc-pressure'][kind] AS waste_kind, least(top, total_ms) * CASE kind WHEN 1 THEN 0.5 WHEN 3 THEN 0.8 ELSE 1 END AS effective_ms FROM k),
y AS (SELECT *, sum(effective_ms) OVER () AS whole, row_number() OVER v AS place, coalesce(sum(effective_ms) OVER (ORDER BY effective_ms DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WINDOW v AS (ORDER BY effective_ms DESC, component))"""


@query("optimization_candidates", f"WITH {_CANDIDATES} SELECT component, waste_kind, round(predicted_ms, 4) AS predicted_ms, round(effective_ms, 4) AS effective_ms, round(1 / greatest(1e-6, 1 - effective_ms / whole * waste_prior), 6) AS amdahl_ceiling, CAST(place AS INT) AS place FROM y WHERE place <= 12 AND before / whole < 0.9")
def _candidates(spark, d):
    e = read_table(spark, d, "events").select(F.concat_ws(".", "event_type", (F.col("event_id") % 40).cast("string")).alias("component"), F.date_format("ts", "dd").alias("session_id"), F.dayofmonth("ts").alias("at"), F.col("value").alias("ms"), (F.col("event_id") % 7 * 1000).alias("bytes"), F.concat("props", (F.col("event_id") % 3).cast("string")).alias("args"))
    timings = e.groupBy("component", "session_id").agg(F.max("at").alias("at"), F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), (F.max("at") * 0.7).alias("gc_pause_ms"), F.sum("bytes").alias("alloc_bytes"))
    cache = e.groupBy("component", "args").agg(F.count("*").alias("n"), F.sum("ms").alias("ms")).where("n > 1").groupBy("component").agg(F.sum(F.col("ms") * (F.col("n") - 1) / F.col("n")).alias("reclaimable_ms"))
    signals = traces.span_signals(_spans(spark, d))
    signals = signals.select(F.concat("component", F.lit(".0")).alias("component"), *[(F.col(c) / 1e7).alias(c) for c in _ROUNDED], "n_count", "serial_count", "wait_count", "n_parent")
    names = e.select("component", F.split("component", r"\.")[1].cast("int").alias("k")).distinct()
    calls = names.join(names.select(F.col("component").alias("src"), ((F.col("k") + 39) % 40).alias("k")), "k").select("src", F.col("component").alias("dst"))
    calibration = spark.createDataFrame([("cache", 0.5), ("per-call", 0.8), ("wait", float("nan")), ("other", 3.0)], "waste_kind string, ratio double")
    out = traces.optimization_candidates(timings, signals, cache, calls, calibration)
    return out.select("component", "waste_kind", r("predicted_ms", 4).alias("predicted_ms"), r("effective_ms", 4).alias("effective_ms"), r("amdahl_ceiling").alias("amdahl_ceiling"), "place")
