"""Readers of span logs (JSON lines) and other artifacts, with explicit schemas; damaged lines are counted, not raised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "struct<v:string,type:string,len:bigint,head:string,elem_type:string,keys_head:array<string>,shape:array<bigint>,dtype:string,cols_head:array<string>,sha256:string,redacted:boolean,truncated:boolean,summary_error:string>"
SPAN = f"""ts timestamp, request_id string, component string, event string, level string, depth bigint, parent_component string, thread_id bigint,
args_hash string, args_schema string, args_summary map<string,{SUMMARY}>, duration_ms double, blocked_ms double, mem_delta_bytes bigint, status string, error_type string,
error_message string, error_stack string, result_hash string, result_schema string, result_summary {SUMMARY}, oracle_violations array<string>, determinism_sources array<string>,
side_effects array<struct<kind:string,target_id:string,hash:string>>, call_count_in_request bigint, capture_scope string, symbol_id string,
hits array<struct<request_id:string,file:string,line:bigint,src:bigint,dst:bigint>>, _bad string"""
DECISION = "type string, ts double, decision_id string, epoch string, action struct<top_k:bigint,policy:string>, served_top_k bigint, propensity double, fallback boolean, latency_ms double, result_count bigint, result_hashes array<string>, source string, reward double"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All lines with their file, its time and their order in it (``seq`` grows along a file); ``_bad`` holds what could not be read."""
    reader = spark.read.schema(schema if "_bad" in schema else f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true")
    # A task reads its blocks in order and numbers their lines upwards, so block and number together order a file; they are never taken modulo.
    seq = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("captured_ts"), seq.alias("seq"))


class Trace:
    """The row families of a span log: ``spans`` (enter and exit), ``gc``, ``branches`` and how many lines were skipped."""

    def __init__(self, lines: DataFrame):
        self.lines = lines
        valid = F.col("event").isin("enter", "exit") & F.col("ts").isNotNull() & F.col("request_id").isNotNull() & F.col("component").isNotNull() & F.col("depth").isNotNull()
        self.spans = lines.where(F.col("_bad").isNull() & valid).drop("_bad", "hits")
        self.enters, self.exits = self.spans.where("event = 'enter'"), self.spans.where("event = 'exit'")
        self.gc = lines.where("event = 'gc_pause'").select("file", "captured_ts", "duration_ms")
        self.branches = lines.where("event = 'branch_hits'").select("file", F.explode("hits").alias("hit")).select("file", "hit.*")
        self.skipped = lines.agg(F.count_if(F.col("_bad").isNotNull() | ~F.coalesce(F.col("event").isin("gc_pause", "branch_hits", "tracer_calibration") | valid, F.lit(False))).alias("skipped"))


def read_trace(spark: SparkSession, path: str) -> Trace:
    return Trace(read_lines(spark, path, SPAN))


def read_source(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: Parquet, JSON lines or one JSON document."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".json")):
        reader = spark.read.option("multiLine", path.endswith(".json"))
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"no reader for {path!r}")


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def with_tags(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """Sessions by folder: the tag file's epoch and time where there is one, else the file's own time."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    t = tags.select(folder(F.col("file")).alias("_folder"), "epoch", F.timestamp_seconds(F.col("captured_unix")).alias("_at"))
    out = lines.withColumn("_folder", folder(F.col("file"))).join(t, "_folder", "left")
    return out.withColumn("captured_ts", F.coalesce("_at", "captured_ts")).drop("_at").withColumnRenamed("_folder", "session_id")


def openapi_endpoints(spec: DataFrame, column: str = "spec") -> DataFrame:
    """(path, method, operation_id) of OpenAPI documents held as JSON text."""
    methods = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
    paths = F.from_json(F.get_json_object(column, "$.paths"), "map<string,map<string,string>>")
    each = spec.select(F.explode(paths).alias("path", "operations")).select("path", F.explode("operations").alias("method", "operation"))
    return each.where(F.col("method").isin(*methods)).select("path", F.upper("method").alias("method"), F.get_json_object("operation", "$.operationId").alias("operation_id"))


def porcelain_changes(status: DataFrame, column: str = "status") -> DataFrame:
    """Changed files of NUL-separated version-control status text, record by record; a rename or copy is followed by its old name."""
    start = F.struct(F.lit(False).alias("old"), F.array().cast("array<string>").alias("files"))

    def step(acc, part):
        name = F.when(acc["old"], part).otherwise(F.expr("null"))
        status_, file = F.substring(part, 1, 2), F.regexp_replace(part, r"(?s)^.{3}", "")
        return F.struct((~acc["old"] & status_.rlike("[RC]")).alias("old"), F.concat(acc["files"], F.array(F.coalesce(name, file))).alias("files"))

    parts = F.filter(F.split(column, "\x00"), lambda x: x != "")
    return status.select(F.explode(F.aggregate(parts, start, step, lambda acc: acc["files"])).alias("file")).distinct()


def chrome_trace(calls: DataFrame) -> DataFrame:
    """Complete events in microseconds, one JSON text a call; the thread is a stable hash of the request."""
    ts = F.unix_micros("ts")
    return calls.select(F.to_json(F.struct(F.col("component").alias("name"), F.lit("X").alias("ph"), (ts - (F.col("duration_ms") * 1000).cast("long")).alias("ts"), (F.col("duration_ms") * 1000).cast("long").alias("dur"), F.lit(1).alias("pid"), F.pmod(F.xxhash64("request_id"), F.lit(100_000)).alias("tid"))).alias("event"))
