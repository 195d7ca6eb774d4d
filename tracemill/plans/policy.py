"""Queries of the policy operators, over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import board, intervals, policy
from ..registry import query
from ..sources.tables import read_table
from .queries import r

_EPISODES = ["user_id % 8 AS arm", "event_type <> 'error' AS objective", "value > 40 + 5 * (user_id % 8) AS verified"]
_POSTERIORS = f"""e AS (SELECT {', '.join(_EPISODES)} FROM events), p AS (SELECT CAST(a AS INT) AS arm, count(arm) AS n, count(*) FILTER (verified) AS won, (1.0 + won) / (2 + n) AS mean FROM range(8) t(a) LEFT JOIN e ON arm = a AND objective GROUP BY 1)"""


def _arms(spark, d):
    return policy.arm_posteriors(read_table(spark, d, "events").selectExpr(*_EPISODES))


@query("arm_posteriors", f"WITH {_POSTERIORS} SELECT arm, n, CAST(1 + won AS DOUBLE) AS alpha, CAST(1 + n - won AS DOUBLE) AS beta, round(mean, 6) AS mean FROM p")
def _posteriors(spark, d):
    return _arms(spark, d).withColumn("mean", r("mean"))


@query("counterfactual_credit", f"""WITH {_POSTERIORS} SELECT CAST(f AS INT) AS feature, round(sum((x.n + y.n) * (x.mean - y.mean)) / (sum(x.n + y.n) + 2), 6) AS credit, CAST(sum(x.n + y.n) AS BIGINT) AS evidence FROM range(3) t(f) JOIN p x ON (x.arm >> f) % 2 = 1 JOIN p y ON y.arm = x.arm - (1 << f) WHERE x.n > 0 AND y.n > 0 GROUP BY f""")
def _counterfactual(spark, d):
    return policy.counterfactual_credit(_arms(spark, d)).withColumn("credit", r("credit"))


@query("shapley_credit", f"""WITH {_POSTERIORS} SELECT CAST(f AS INT) AS feature, round(sum((x.mean - y.mean) * CASE bit_count(y.arm) WHEN 1 THEN 1 ELSE 2 END / 6.0), 6) AS credit FROM range(3) t(f) JOIN p x ON (x.arm >> f) % 2 = 1 JOIN p y ON y.arm = x.arm - (1 << f) GROUP BY f""")
def _shapley(spark, d):
    return policy.shapley_credit(_arms(spark, d).select("arm", F.col("mean").alias("value"))).withColumn("credit", r("credit"))


@query("optimization_calibration", """WITH o AS (SELECT event_type AS k, abs(value * (event_id % 5 - 2)) / (value + 1) AS x FROM events WHERE event_id % 3 < 2 AND value + 1 > 0), m AS (SELECT avg(x) AS a FROM o)
SELECT k AS waste_kind, count(*) AS n, round(avg(x), 6) AS ratio, round((sum(x) + 3 * any_value(a)) / (count(*) + 3), 6) AS shrunk FROM o, m GROUP BY k""")
def _calibration(spark, d):
    o = read_table(spark, d, "events").selectExpr("event_type AS waste_kind", "CASE event_id % 3 WHEN 0 THEN 'proven' WHEN 1 THEN 'regressed' ELSE 'inconclusive' END AS verdict", "value + 1 AS predicted_ms", "value * (event_id % 5 - 2) AS delta_ms")
    return policy.calibration(o).withColumn("ratio", r("ratio")).withColumn("shrunk", r("shrunk"))


_LOGGED = ["event_id AS decision_id", "event_id % 3 AS action", "CASE event_id % 3 WHEN 0 THEN 0.5D WHEN 1 THEN 0.3D ELSE 0.2D END AS propensity", "value / 100 AS reward", "event_type AS epoch"]


@query("policy_support", """WITH w AS (SELECT CASE WHEN event_id % 3 = 2 THEN 1 / 0.2 END AS raw FROM events), c AS (SELECT raw, coalesce(least(raw, 4.0), 0) AS w FROM w)
SELECT count(*) AS n, count(raw) AS matched, round(count(raw) / count(*), 6) AS overlap, round(sum(w) * sum(w) / sum(w * w), 4) AS ess, 4.0::DOUBLE AS clip, round(count(*) FILTER (raw > 4) / count(*), 6) AS clipped, sum(w) * sum(w) / sum(w * w) >= 25 AND count(*) >= 40 AND count(raw) >= 8 AS supported FROM c""")
def _support(spark, d):
    return policy.support(read_table(spark, d, "events").selectExpr(*_LOGGED), 2, 4.0).select("n", "matched", r("overlap").alias("overlap"), r("ess", 4).alias("ess"), "clip", r("clipped").alias("clipped"), "supported")


@query("epoch_deltas", """WITH s AS (SELECT event_type AS epoch, event_id % 3 AS a, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END AS p, value / 100 AS y, (row_number() OVER (PARTITION BY event_type, event_id % 3 ORDER BY sha256(CAST(event_id AS VARCHAR))) - 1) % 2 AS fold FROM events),
m AS (SELECT epoch, 1 - fold AS fold, a, avg(y) AS q FROM s GROUP BY 1, 2, 3) SELECT s.epoch, count(*) AS n, round(avg(t.q - b.q + CASE s.a WHEN 1 THEN (y - t.q) / p WHEN 0 THEN -(y - b.q) / p ELSE 0 END), 6) AS delta, avg(t.q - b.q + CASE s.a WHEN 1 THEN (y - t.q) / p WHEN 0 THEN -(y - b.q) / p ELSE 0 END) >= -0.1 AS ok
FROM s JOIN m t ON t.epoch = s.epoch AND t.fold = s.fold AND t.a = 1 JOIN m b ON b.epoch = s.epoch AND b.fold = s.fold AND b.a = 0 GROUP BY 1 HAVING count(*) >= 20""")
def _epochs(spark, d):
    return policy.epoch_deltas(read_table(spark, d, "events").selectExpr(*_LOGGED), 0, 1).withColumn("delta", r("delta"))


_DRAWS = 100
_DRAWN = f"""s AS (SELECT event_id AS id, event_id % 3 AS a, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END AS p, value / 100 AS y, (row_number() OVER (PARTITION BY event_id % 3 ORDER BY sha256(CAST(event_id AS VARCHAR))) - 1) % 2 AS fold, ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 2147483647 AS h FROM events),
k AS (SELECT b, ('0x' || substr(md5('0|' || b), 1, 15))::BIGINT AS x FROM range({_DRAWS}) t(b)), c(t) AS (SELECT unnest(list_transform(range(13), lambda i: list_sum(list_transform(range(i + 1), lambda j: exp(-1) / gamma(j + 1)))))),
u AS (SELECT s.*, b AS draw, (h * (1 + x % 2147483646) + x // 2147483647 % 2147483647) % 2147483647 / 2147483647.0 AS u FROM s, k), w AS (SELECT id, a, p, y, fold, draw, (SELECT count(*) FROM c WHERE t <= u) AS w FROM u UNION ALL SELECT id, a, p, y, fold, -1, 1 FROM s),
m AS (SELECT draw, 1 - fold AS fold, a, sum(w * y) / sum(w) AS q FROM w GROUP BY 1, 2, 3),
v AS (SELECT w.draw, sum(w * (t.q + CASE WHEN w.a = 1 THEN (y - t.q) / p ELSE 0 END)) / sum(w) AS dr, sum(w * (t.q - b.q + CASE w.a WHEN 1 THEN (y - t.q) / p WHEN 0 THEN -(y - b.q) / p ELSE 0 END)) / sum(w) AS delta FROM w JOIN m t ON t.draw = w.draw AND t.fold = w.fold AND t.a = 1 JOIN m b ON b.draw = w.draw AND b.fold = w.fold AND b.a = 0 GROUP BY 1)"""


@query("bootstrap_values", f"WITH {_DRAWN} SELECT CAST(draw AS INT) AS draw, round(dr, 8) AS dr, round(delta, 8) AS delta FROM v")
def _draws(spark, d):
    return intervals.bootstrap_values(read_table(spark, d, "events").selectExpr(*_LOGGED), 0, 1, _DRAWS).select("draw", r("dr", 8).alias("dr"), r("delta", 8).alias("delta"))


@query("bootstrap_interval", f"""WITH {_DRAWN}, o AS (SELECT list(delta ORDER BY delta) AS v, list(dr ORDER BY dr) AS w FROM v WHERE draw >= 0) SELECT (SELECT count(*) FROM events) AS n, round(delta, 8) AS delta, CAST(len(list_filter(o.v, lambda x: x < delta)) AS INT) AS below, round(o.v[3], 8) AS plain_low, round(o.v[97], 8) AS plain_high, round(dr, 8) AS dr, round(o.w[3], 8) AS dr_low, round(o.w[97], 8) AS dr_high FROM v, o WHERE draw = -1""")
def _interval(spark, d):
    o = intervals.bootstrap_delta(read_table(spark, d, "events").selectExpr(*_LOGGED), 0, 1, _DRAWS)
    return o.select("n", "below", *[r(c, 8).alias(c) for c in ("delta", "plain_low", "plain_high", "dr", "dr_low", "dr_high")])


_ENTRIES = [
    "CAST(c_custkey AS STRING) AS id", "c_custkey AS row", "c_mktsegment AS kind", "CASE c_custkey % 6 WHEN 0 THEN 'posted' WHEN 1 THEN 'resolved' WHEN 2 THEN 'exhausted' ELSE 'dispatched' END AS status", "CAST(c_custkey % 7 * 3000 AS DOUBLE) AS dispatched_at", "0.0D AS updated_at",
    "CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS STRING) END AS episode_id", "c_custkey % 2 AS retry_count", "c_custkey % 3 AS misses", "CASE WHEN c_custkey % 5 = 0 THEN 's9' ELSE 's8' END AS last_session", "c_custkey AS place",
]
_LEDGER = [
    "CASE o_orderkey % 3 WHEN 0 THEN 'episode_end' ELSE 'optimization_outcome' END AS type", "o_orderkey AS place", "CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS row", "CASE WHEN o_orderkey % 13 > 0 THEN CAST(datediff(CAST(o_orderdate AS DATE), DATE '1985-01-01') AS DOUBLE) END AS at",
    "'BUILDING' AS waste_kind", "CASE o_orderkey % 5 WHEN 0 THEN 'regressed' WHEN 1 THEN 'reverted-behavior' WHEN 2 THEN 'proven' END AS verdict", "CAST(NULL AS DOUBLE) AS delta_ms", "CAST(NULL AS DOUBLE) AS predicted_ms", "CAST(o_orderkey % 40 AS STRING) AS episode_id", "CAST(NULL AS STRING) AS bridge_episode_id",
]
_BOARD = f"""b AS (SELECT {', '.join(_ENTRIES).replace('0.0D', '0.0').replace('AS STRING', 'AS VARCHAR')} FROM customer), e AS (SELECT {', '.join(_LEDGER).replace('AS STRING', 'AS VARCHAR').replace("datediff(CAST(o_orderdate AS DATE), DATE '1985-01-01')", "date_diff('day', DATE '1985-01-01', CAST(o_orderdate AS DATE))").replace('AS at', 'AS told')} FROM orders),
o AS (SELECT id, arg_min(coalesce(verdict, 'resolved'), e.place) AS v FROM b JOIN e USING (row) WHERE status = 'dispatched' AND type = 'optimization_outcome' AND (told IS NULL OR told + 1 >= dispatched_at) GROUP BY 1),
c AS (SELECT b.*, CASE WHEN v IN ('regressed', 'reverted-behavior') THEN CASE WHEN retry_count + 1 < 2 THEN 'reopened' ELSE 'exhausted' END WHEN v IS NOT NULL THEN 'resolved' END AS c1 FROM b LEFT JOIN o USING (id)),
d AS (SELECT *, coalesce(CASE c1 WHEN 'reopened' THEN 'posted' ELSE c1 END, status) AS s1, CASE WHEN c1 IS NULL THEN misses ELSE 0 END AS m1, CASE WHEN c1 IN ('reopened', 'exhausted') THEN 's9' ELSE last_session END AS l1,
EXISTS (FROM e WHERE type IN ('episode_end', 'optimization_outcome') AND (c.episode_id IS NULL OR e.episode_id = c.episode_id) AND (told IS NULL OR told + 1 >= c.dispatched_at)) AS alive FROM c),
f AS (SELECT *, CASE WHEN s1 = 'dispatched' THEN CASE WHEN l1 = 's9' THEN NULL WHEN alive THEN CASE WHEN m1 > 0 THEN 'reset' END WHEN m1 + 1 >= 3 THEN 'hung' ELSE 'missed' END WHEN s1 = 'exhausted' THEN CASE WHEN l1 <> 's9' THEN 'aged' END
WHEN row % 8 = 0 THEN CASE WHEN m1 > 0 THEN 'reset' END WHEN l1 = 's9' THEN NULL WHEN m1 + 1 >= 3 THEN 'expired' ELSE 'missed' END AS c2 FROM d)"""


@query("board_reconciliation", f"""WITH {_BOARD} SELECT id, CASE c2 WHEN 'hung' THEN CASE WHEN retry_count + 1 < 2 THEN 'posted' ELSE 'exhausted' END WHEN 'expired' THEN 'expired' ELSE s1 END AS status, CAST(CASE WHEN c2 IN ('reset', 'hung') THEN 0 WHEN c2 IS NOT NULL THEN m1 + 1 ELSE m1 END AS INT) AS misses,
CASE c2 WHEN 'hung' THEN CASE WHEN retry_count + 1 < 2 THEN 'reopened' ELSE 'exhausted' END ELSE coalesce(c2, c1) END AS change FROM f""")
def _board(spark, d):
    customers = read_table(spark, d, "customer")
    fresh = customers.where("c_custkey % 8 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    out = board.reconcile(customers.selectExpr(*_ENTRIES), read_table(spark, d, "orders").selectExpr(*_LEDGER), fresh, "s9", 1e9)
    return out.select("id", "status", "misses", "change")
