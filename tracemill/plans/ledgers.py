"""Queries of ledger, reward and retrieval functions; the SQL is written from their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, retrieval, statistics
from ..registry import query
from ..sources.tables import read_table
from .queries import r


@query("arm_bounds", """WITH a AS (SELECT event_type AS arm, count(*) AS n, avg(value / 500) AS m, var_pop(value / 500) AS v FROM events GROUP BY 1), o AS (SELECT avg(value / 500) AS overall FROM events)
SELECT arm, n, round(m - sqrt(2 * v * ln(30) / n) - 6 * ln(30) / n, 8) AS bound, round((n * m + 2 * overall) / (n + 2), 8) AS shrunk, CAST(1 + (n - 1) * 0.5 AS DOUBLE) AS prior FROM a, o""")
def _bounds(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 500).alias("y"))
    a = e.groupBy("arm").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).join(F.broadcast(e.agg(F.avg("y").alias("overall"))))
    return a.select("arm", "n", r(statistics.bernstein_bound(F.col("m"), F.col("v"), F.col("n")), 8).alias("bound"), r(statistics.shrunk_mean(F.col("m"), F.col("n"), F.col("overall")), 8).alias("shrunk"), r(statistics.decayed_prior(F.col("n")), 4).alias("prior"))


_EPISODE = ["o_orderpriority AS kind", "o_orderstatus = 'F' AS verified", "o_orderkey % 4 + 1 AS attempts", "o_custkey % 3 AS budget", "o_orderkey % 10 = 0 AS aborted", "CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / 400000 END AS speed"]


@query("episode_rewards", f"""WITH e AS (SELECT {', '.join(_EPISODE)} FROM orders), x AS (SELECT *, CASE WHEN aborted THEN -1 WHEN NOT verified THEN 0 ELSE 1 - (attempts - 1) / greatest(budget, 1) END AS reward FROM e)
SELECT kind, round(avg(reward), 8) AS reward, round(avg(CASE WHEN speed IS NULL THEN reward ELSE (0.7 * reward + 0.3 * speed) / 1.0 END), 8) AS both FROM x GROUP BY 1""")
def _episodes(spark, d):
    e = read_table(spark, d, "orders").selectExpr(*_EPISODE)
    e = e.withColumn("reward", statistics.episode_reward(F.col("verified"), F.col("attempts"), F.col("budget"), F.col("aborted")))
    return e.groupBy("kind").agg(r(F.avg("reward"), 8).alias("reward"), r(F.avg(statistics.reward_mean([(F.col("reward"), 0.7), (F.col("speed"), 0.3)])), 8).alias("both"))


@query("greedy_propensities", "SELECT user_id, round(sum(0.2 / 4 + CASE WHEN event_id % 4 = user_id % 4 THEN 0.8 ELSE 0 END), 6) AS p FROM events GROUP BY 1")
def _greedy(spark, d):
    p = statistics.greedy_propensity(F.col("event_id") % 4, F.col("user_id") % 4, 4, 0.2)
    return read_table(spark, d, "events").groupBy("user_id").agg(r(F.sum(p)).alias("p"))


@query("noise_bands", """WITH o AS (SELECT o_custkey, o_totalprice AS x, median(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders)
SELECT o_custkey, count(*) AS n, round(CASE WHEN count(*) = 1 THEN 0.1 * abs(any_value(m)) ELSE greatest(1.4826 * median(abs(x - m)), 0.05 * abs(any_value(m))) END, 7) AS band FROM o GROUP BY 1""")
def _bands(spark, d):
    o = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list("o_totalprice").alias("v"))
    return o.select("o_custkey", "n", r(lifecycle.noise_band(F.col("v"), F.lit(0.05)), 7).alias("band"))


_MEASURED = ["o_totalprice AS before", "o_totalprice * (0.8 + o_orderkey % 5 * 0.1) AS after", "20000.0 AS band", "o_orderkey % 7 > 0 AS behaves", "o_orderkey % 11 > 0 AS changed"]


@query("measured_outcomes", f"""WITH m AS (SELECT {', '.join(_MEASURED)} FROM orders) SELECT CASE WHEN NOT changed THEN 'dismissed' WHEN NOT behaves OR after - before > band THEN 'regressed' WHEN before - after > band THEN 'proven' ELSE 'inconclusive' END AS verdict, count(*) AS n FROM m GROUP BY 1""")
def _measured(spark, d):
    m = read_table(spark, d, "orders").selectExpr(*_MEASURED)
    return m.groupBy(lifecycle.reconciled(*map(F.col, ("after", "before", "band", "behaves", "changed"))).alias("verdict")).agg(F.count("*").alias("n"))


@query("carried_epochs", """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END AS sha, p_partkey % 5 AS epoch FROM part WHERE p_partkey % 4 > 0)
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 4 > 0 THEN p_partkey % 5 ELSE (SELECT max(epoch) FROM p) + 1 END AS epoch FROM part""")
def _carried(spark, d):
    p = read_table(spark, d, "part")
    before = p.where("p_partkey % 4 > 0").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_brand END AS sha", "p_partkey % 5 AS epoch")
    return lifecycle.carried_epochs(p.selectExpr("p_partkey AS id", "p_brand AS sha"), before).select("id", "epoch")


_GAINS = "SELECT l_orderkey, o_orderpriority AS category, list(CASE l_suppkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END ORDER BY l_linenumber, l_suppkey, l_partkey) AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"
_DCG = "coalesce(list_sum(list_transform({v}, lambda x, i: (pow(2, x) - 1) / log2(i + 1))), 0)"


@query("retrieval_evaluation", f"""WITH a AS ({_GAINS}), e AS (SELECT category, coalesce(1 / list_position(list_transform(g, lambda x: x > 0), true), 0) AS mrr, {', '.join(f"CAST(len(list_filter(g[1:{k}], lambda x: x > 0)) > 0 AS INT) AS hit{k}, CASE WHEN {_DCG.format(v=f'list_reverse_sort(g)[1:{k}]')} > 0 THEN {_DCG.format(v=f'g[1:{k}]')} / {_DCG.format(v=f'list_reverse_sort(g)[1:{k}]')} ELSE 0 END AS ndcg{k}" for k in (1, 5, 10))} FROM a)
SELECT category, count(*) AS n, round(avg(mrr), 6) AS mrr, {', '.join(f'round(avg(hit{k}), 6) AS hit{k}, round(avg(ndcg{k}), 6) AS ndcg{k}' for k in (1, 5, 10))} FROM e GROUP BY ROLLUP (category)""")
def _evaluation(spark, d):
    gain = F.when(F.col("l_suppkey") % 5 == 0, 3).when(F.col("l_suppkey") % 5 == 1, 1).otherwise(0)
    lines = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.groupBy("l_orderkey", F.col("o_orderpriority").alias("category")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", gain.alias("g")))).alias("x")).select("category", F.col("x.g").alias("gains"), F.col("x.g").alias("ideal"))
    out = retrieval.evaluate(rows)
    return out.select("category", "n", r("mrr").alias("mrr"), *[r(f"{m}{k}").alias(f"{m}{k}") for k in (1, 5, 10) for m in ("hit", "ndcg")])


@query("slices_and_modules", """WITH h AS (SELECT p_brand AS file, CASE WHEN p_partkey % 9 = 0 THEN 'module' ELSE 'function' END AS kind, p_partkey AS id, p_partkey % 40 AS name, p_retailprice AS score FROM part), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY score DESC, id) = 1),
m AS (SELECT file, arg_max(id, (score, -id)) AS mid, max(score) AS ms FROM o WHERE kind = 'module' GROUP BY 1), s AS (SELECT file, arg_max(id, (score, -id)) AS sid, max(score) AS ss FROM o WHERE kind <> 'module' GROUP BY 1)
SELECT file, kind, id, round(CASE WHEN ms > ss AND ss >= 0.5 * ms AND id = mid THEN ss WHEN ms > ss AND ss >= 0.5 * ms AND id = sid THEN ms ELSE score END, 4) AS score FROM o LEFT JOIN m USING (file) LEFT JOIN s USING (file)""")
def _slices(spark, d):
    h = read_table(spark, d, "part").selectExpr("p_brand AS file", "CASE WHEN p_partkey % 9 = 0 THEN 'module' ELSE 'function' END AS kind", "p_partkey AS id", "p_partkey % 40 AS name", "p_retailprice AS score")
    return retrieval.swapped_modules(retrieval.one_slice_each(h).drop("name")).withColumn("score", r("score", 4))
