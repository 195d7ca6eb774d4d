"""Aggregations over calls: rollups, symbol and request statistics, outcome labels, suspects, coverage.

``calls`` has one row for each finished call: session_id, seq, ts, request_id, component, parent_component, depth, duration_ms,
status and, where an operator says so, more. All of these are grouped aggregations with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.percentiles import floor_index_at, interpolated
from ..functions.predicates import is_error
from .ranges import order_statistics


def rollup(calls: DataFrame, bucket: str = "60 seconds") -> DataFrame:
    """Per time bucket and component: counts, error rate, latency percentiles, rate, calls of the busiest requests."""
    seconds = F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {bucket})")
    rows = calls.where(F.col("component").isNotNull()).withColumn("bucket", F.window("ts", bucket).start)
    main = rows.groupBy("bucket", "component").agg(
        F.count("*").alias("calls"), F.count_if(is_error()).alias("error_count"), *[interpolated(F.col("duration_ms"), p / 100).alias(f"latency_p{p}") for p in (50, 95, 99)])
    per_request = rows.groupBy("bucket", "component", "request_id").agg(F.count("*").alias("n"))
    per_request = per_request.groupBy("bucket", "component").agg(F.avg("n").alias("mean_calls_per_request"), F.max("n").alias("max_calls_per_request"))
    out = main.join(per_request, ["bucket", "component"], "left")
    return out.withColumn("error_rate", F.col("error_count") / F.col("calls")).withColumn("qps", F.col("calls") / seconds)


def symbol_stats(calls: DataFrame) -> DataFrame:
    """Per component: calls, total time, errors, last seen, median, and high percentiles by floor index."""
    d, rows = F.col("duration_ms"), calls.where(F.col("component").isNotNull())
    main = rows.groupBy("component").agg(F.count("*").alias("calls"), F.sum(d).alias("total_ms"), F.count_if(is_error()).alias("errors"), F.max("ts").alias("last_seen"), interpolated(d, 0.5).alias("p50"))
    high = order_statistics(rows.select("component", "duration_ms"), ["component"], "duration_ms", {"p95": floor_index_at(0.95), "p99": floor_index_at(0.99)}, "durations").drop("n")
    return main.join(high, "component", "left").withColumn("error_rate", F.col("errors") / F.col("calls"))


def request_rows(calls: DataFrame) -> DataFrame:
    """Per request: its first and last root in order of ``seq``, how it ended, how long it took, how many calls it made."""
    root = F.col("depth") == 0
    order = F.when(root, F.col("seq"))
    return calls.groupBy("request_id").agg(
        F.min_by("component", order).alias("entry_component"), F.max_by("status", order).alias("status"), F.max_by("duration_ms", order).alias("duration_ms"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("calls"))


def trace_summary(calls: DataFrame, top: int = 20) -> DataFrame:
    """The busiest components with their share of all calls."""
    each = calls.groupBy("component").agg(F.count("*").alias("calls"), F.countDistinct("request_id").alias("requests"))
    total = each.agg(F.sum("calls").alias("all_calls"))
    return each.join(F.broadcast(total)).withColumn("share", F.col("calls") / F.col("all_calls")).orderBy(F.desc("calls"), "component").limit(top)


def dependency_edges(calls: DataFrame, min_support: int = 5) -> DataFrame:
    """Caller and callee pairs seen at least ``min_support`` times."""
    return calls.where(F.col("parent_component").isNotNull() & F.col("component").isNotNull()).groupBy(F.col("parent_component").alias("src"), F.col("component").alias("dst")).agg(F.count("*").alias("weight")).where(F.col("weight") >= min_support)


def outcomes(calls: DataFrame, slow_factor: float = 1.5, oracle: Column | None = None) -> DataFrame:
    """Labels of each request: fail, slow (its first call takes more than the factor times the 95th percentile), wrong (an oracle's verdict), else ok."""
    first = calls.groupBy("request_id").agg(
        F.max(is_error().cast("int")).alias("failed"), F.min_by("duration_ms", F.struct("ts", "seq")).alias("first_ms"), F.min((oracle if oracle is not None else F.lit(True)).cast("int")).alias("right"))
    limit = calls.agg(interpolated(F.col("duration_ms"), 0.95).alias("p95"))
    labels = F.array_compact(F.array(F.when(F.col("failed") == 1, "fail"), F.when(F.col("first_ms") > slow_factor * F.col("p95"), "slow"), F.when(F.col("right") == 0, "wrong")))
    return first.join(F.broadcast(limit)).select("request_id", F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("ok"))).alias("labels"))


def outcome_lift(calls: DataFrame, labels: DataFrame, top: int = 500) -> DataFrame:
    """How much likelier a component is in requests with a label than in the others."""
    seen = calls.where(F.col("component").isNotNull()).select("request_id", "component").distinct()
    each = labels.select("request_id", F.explode("labels").alias("label"))
    n_all = labels.agg(F.count("*").alias("n_all"))
    per_label = each.groupBy("label").agg(F.count("*").alias("n_label"))
    with_component = seen.join(labels.select("request_id"), "request_id").groupBy("component").agg(F.count("*").alias("n_component"))
    both = seen.join(each, "request_id").groupBy("component", "label").agg(F.count("*").alias("support"))
    out = both.join(F.broadcast(per_label), "label").join(with_component, "component").join(F.broadcast(n_all))
    p = F.col("support") / F.col("n_label")
    q = F.when(F.col("n_all") > F.col("n_label"), (F.col("n_component") - F.col("support")) / (F.col("n_all") - F.col("n_label"))).otherwise(F.lit(0.0))
    return out.select("label", "component", "support", (p - q).alias("lift")).orderBy(F.desc("lift"), F.desc("support"), "label", "component").limit(top)


def suspects(calls: DataFrame, top: int | None = 20) -> DataFrame:
    """Ochiai suspiciousness of each component over distinct requests that failed or passed."""
    status = calls.groupBy("request_id").agg(F.max(is_error().cast("int")).alias("failed"))
    direct = calls.where(F.col("component").isNotNull()).groupBy("component").agg(F.count_if(is_error()).alias("direct_errors"))
    seen = calls.where(F.col("component").isNotNull()).select("request_id", "component").distinct().join(status, "request_id")
    spectrum = seen.groupBy("component").agg(F.sum("failed").alias("failed_with"), F.sum(1 - F.col("failed")).alias("passed_with"))
    total = status.agg(F.sum("failed").alias("failed_runs"))
    ef = F.col("failed_with")
    score = F.when(F.col("failed_runs") * (ef + F.col("passed_with")) > 0, ef / F.sqrt(F.col("failed_runs") * (ef + F.col("passed_with")))).otherwise(F.lit(0.0))
    out = spectrum.join(F.broadcast(total)).join(direct, "component").select("component", "failed_with", "passed_with", "direct_errors", score.alias("score"))
    ordered = out.orderBy(F.desc("score"), F.desc("direct_errors"), F.desc("failed_with"), "component")
    return ordered if top is None else ordered.limit(top)


def coverage(calls: DataFrame) -> DataFrame:
    """Per component: outcomes, time and requests; errors of its latest session only."""
    rows = calls.where(F.col("component").isNotNull())
    per = rows.groupBy("component", "session_id").agg(F.count_if(~is_error()).alias("ok"), F.count_if(is_error()).alias("errors"), F.sum("duration_ms").alias("ms"))
    newest = F.coalesce(F.max_by("errors", "session_id"), F.sum("errors"))  # without any session's name all of its calls are of one
    sums = per.groupBy("component").agg(F.sum("ok").alias("ok"), F.sum("errors").alias("errors"), F.sum("ms").alias("total_ms"), newest.alias("current_errors"))
    return sums.join(rows.groupBy("component").agg(F.countDistinct("request_id").alias("requests")), "component").select("component", "ok", "errors", "total_ms", "requests", "current_errors")


def callers_of(calls: DataFrame, component: str) -> DataFrame:
    return calls.where(F.col("component") == component).groupBy(F.col("parent_component").alias("caller")).agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("total_ms")).where("caller is not null")


def value_profile(values: DataFrame, top: int = 8) -> DataFrame:
    """Of (name, kind, number): rows, nulls, distinct values, range; and the commonest values by rank."""
    counted = values.groupBy("name", "kind", "number").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), F.asc_nulls_last("number")))
    return counted.withColumn("rank", rank).groupBy("name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("number").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.countDistinct("number").alias("distinct_values"), F.min("number").alias("least"), F.max("number").alias("most"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "number", "n")))).alias("commonest"))


def histogram(values: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """Bins of equal width; the last one is closed. A constant column is one bin."""
    x = F.col(column).cast("double")
    span = values.where(x.isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((x - F.col("lo")) / width).cast("int"))).otherwise(F.lit(0))
    return values.where(x.isNotNull()).join(F.broadcast(span)).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))


def error_clusters(calls: DataFrame) -> DataFrame:
    """Errors by component with the sorted kinds seen, and a signature of both."""
    out = calls.where(is_error()).groupBy("component").agg(F.count("*").alias("defects"), F.array_sort(F.collect_set(F.coalesce("error_type", F.lit("")))).alias("kinds"))
    return out.withColumn("signature", F.concat_ws("|", F.col("component"), F.array_join("kinds", ",")))


def memory_by_component(calls: DataFrame) -> DataFrame:
    """Calls and net bytes where memory was measured; unmeasured is not 0."""
    return calls.where(F.col("mem_delta_bytes").isNotNull()).groupBy("component").agg(F.count("*").alias("calls"), F.sum("mem_delta_bytes").alias("bytes"))


def root_counts(calls: DataFrame) -> DataFrame:
    """Entries of roots that are named like a request: a verb and a path."""
    return calls.where((F.col("depth") == 0) & F.col("component").rlike(r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) /\S*$")).groupBy("component").agg(F.count("*").alias("hits"))


def cache_candidates(calls: DataFrame) -> DataFrame:
    """Components whose result depends on the arguments alone: repeats of arguments and the time they cost."""
    by_args = calls.where(F.col("args_hash").isNotNull() & ~is_error()).groupBy("component", "args_hash").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("ms"), F.countDistinct("result_hash").alias("results"))
    out = by_args.groupBy("component").agg(
        F.sum("n").alias("calls"), F.count("*").alias("distinct_args"), F.max("results").alias("most_results"), F.sum(F.when(F.col("n") > 1, F.col("ms") * (F.col("n") - 1) / F.col("n")).otherwise(0.0)).alias("reclaimable_ms"))
    return out.where((F.col("most_results") <= 1) & (F.col("calls") > F.col("distinct_args")))


def outcome_profile(rows: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Counts of ``group`` combinations within ``key`` and, by grouping sets, their totals."""
    return rows.rollup(key, *group).agg(F.count("*").alias("n")).where(F.col(key).isNotNull())


def clusters(rows: DataFrame, signature: Column, exemplar: Column, order: Column) -> DataFrame:
    """Failures with one signature: how many, and the first of them."""
    return rows.groupBy(signature.alias("signature")).agg(F.count("*").alias("n"), F.min_by(exemplar, order).alias("exemplar"))


def pooled_arms(arms: DataFrame, dimensions: list[str]) -> DataFrame:
    """Posterior counts summed over each dimension alone, in one pass by grouping sets."""
    sets = arms.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])).alias("x"), "alpha", "beta", "plays")
    out = sets.groupBy("x.dimension", "x.level").agg(F.sum("alpha").alias("alpha"), F.sum("beta").alias("beta"), F.sum("plays").alias("plays"))
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def arm_stats(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("arm").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), F.var_pop("reward").alias("variance"))
