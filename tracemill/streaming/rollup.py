"""Streaming rollup of closed span files: the batch operator's counts with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_error
from ..sources.spans import SPAN


def stream_spans(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Files that are closed when they appear; a file that still grows is not read again."""
    return spark.readStream.schema(SPAN).option("maxFilesPerTrigger", files).option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and event = 'exit'")


def stream_rollup(calls: DataFrame, bucket: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts, errors and mean latency by bucket and component; a bucket is final when the watermark has passed it."""
    rows = calls.where("component is not null").withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", bucket).alias("w"), "component").agg(F.count("*").alias("calls"), F.count_if(is_error()).alias("error_count"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
    return out.select(F.col("w.start").alias("bucket"), "component", "calls", "error_count", "mean_ms", "max_ms")
