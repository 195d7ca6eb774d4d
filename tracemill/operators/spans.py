"""Calls from enter and exit events, by windows within one thread of a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def call_forest(log: DataFrame) -> DataFrame:
    """One row for each enter event: its exit, duration, depth and enclosing call.

    ``log``: request_id, thread_id, seq (order within a thread), ts, component, event (enter or exit). Events pair last in, first out:
    with +1 for an enter and -1 for an exit, an enter that lifts the running sum to a level ends with the next exit that leaves this
    level. An exit without an enter pairs with nothing; an enter without an exit stays open (null exit). The enclosing call of an enter
    is the latest enter one level below. For logs in the order of the calls: where spans are logged when they end, or exits may be lost, see
    ``traces.paired_spans`` (by recorded depths) and ``traces.line_order_spans`` (by components).
    """
    thread = ["request_id", "thread_id"]
    rows = log.where(F.col("event").isin("enter", "exit")).select(*thread, "seq", "ts", "component", "event")
    upto = Window.partitionBy(*thread).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_enter = F.col("event") == "enter"
    level = F.sum(F.when(is_enter, 1).otherwise(-1)).over(upto)
    rows = rows.select("*", F.when(is_enter, level).otherwise(level + 1).alias("level"))
    same = Window.partitionBy(*thread, "level").orderBy("seq")
    ends = F.lead("event").over(same) == "exit"
    calls = rows.select(*thread, "seq", "ts", "component", "event", "level", F.when(ends, F.lead("seq").over(same)).alias("exit_seq"), F.when(ends, F.lead("ts").over(same)).alias("exit_ts")).where(is_enter)
    # Each enter stands at its own level as a possible parent, and one level below as a child.
    both = calls.select("*", F.explode(F.array(F.struct(F.col("level").alias("at"), F.col("seq").alias("parent")), F.struct((F.col("level") - 1).alias("at"), F.lit(None).cast("long").alias("parent")))).alias("place"))
    below = Window.partitionBy(*thread, F.col("place.at")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("*", F.last("place.parent", ignorenulls=True).over(below).alias("parent_seq")).where(F.col("place.parent").isNull())
    lowest = Window.partitionBy(*thread)
    return found.select(*thread, "seq", "component", "ts", "exit_seq", "exit_ts", "parent_seq", (F.col("level") - F.min("level").over(lowest)).alias("depth"))


def self_times(forest: DataFrame) -> DataFrame:
    """(component, calls, total_ms, self_ms): what is left of closed calls after their closed children; never below 0 for a call."""
    ms = (F.unix_micros("exit_ts") - F.unix_micros("ts")) / 1000
    closed = forest.where(F.col("exit_seq").isNotNull()).select("request_id", "thread_id", "seq", "parent_seq", "component", ms.alias("ms"))
    children = closed.groupBy("request_id", "thread_id", F.col("parent_seq").alias("seq")).agg(F.sum("ms").alias("inner_ms"))
    own = closed.join(children, ["request_id", "thread_id", "seq"], "left").withColumn("self", F.greatest(F.col("ms") - F.coalesce("inner_ms", F.lit(0.0)), F.lit(0.0)))
    return own.groupBy("component").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.sum("self").alias("self_ms"))


def repeated_children(forest: DataFrame, least: int = 3) -> DataFrame:
    """Calls that make ``least`` or more calls of one component: (component of the caller, child, callers, calls)."""
    calls = forest.where(F.col("parent_seq").isNotNull()).groupBy("request_id", "thread_id", F.col("parent_seq").alias("seq"), F.col("component").alias("child")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return calls.join(forest.select("request_id", "thread_id", "seq", "component"), ["request_id", "thread_id", "seq"]).groupBy("component", "child").agg(F.count("*").alias("callers"), F.sum("n").alias("calls"))
