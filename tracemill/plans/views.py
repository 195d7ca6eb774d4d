"""The test tables as the rows that the operators read, as DataFrames and, for checking, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished calls: a user is a request, the event before is the caller, a day is a session."""
    e = read_table(spark, sf_dir, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("request_id"), F.col("event_type").alias("component"), before.alias("parent_component"),
        F.when(before.isNull(), 0).otherwise(1).alias("depth"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").when(F.col("value") > 200, "error").otherwise("ok").alias("status"),
        F.concat_ws("|", F.pmod("user_id", F.lit(50)).cast("string"), "event_type").alias("args_hash"), F.when(F.pmod("user_id", F.lit(50)) < 45, F.lit("same")).otherwise(F.pmod("event_id", F.lit(3)).cast("string")).alias("result_hash"), F.col("event_type").alias("error_type"))


CALLS = """calls AS (SELECT strftime(ts, '%Y-%m-%d') AS session_id, event_id AS seq, ts, CAST(user_id AS VARCHAR) AS request_id, event_type AS component,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_component,
  CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 0 ELSE 1 END AS depth, value AS duration_ms,
  CASE WHEN event_type = 'error' OR value > 200 THEN 'error' ELSE 'ok' END AS status, CAST(user_id % 50 AS VARCHAR) || '|' || event_type AS args_hash,
  CASE WHEN user_id % 50 < 45 THEN 'same' ELSE CAST(event_id % 3 AS VARCHAR) END AS result_hash, event_type AS error_type FROM events)"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(metric, value) of the events before and after the middle of the month."""
    e = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return e.where(F.col("ts") < cut).drop("ts"), e.where(F.col("ts") >= cut).drop("ts")


HALVES = "r AS (SELECT event_type AS metric, value FROM events WHERE ts < TIMESTAMP '2024-01-15'), c AS (SELECT event_type AS metric, value FROM events WHERE ts >= TIMESTAMP '2024-01-15')"
