"""Incremental reading of log files that grow, are rotated or are cut while they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: path, modified, offset (bytes of it that were read, up to the end of a line), head_bytes and head (digest of its first bytes).
MANIFEST = "path string, modified timestamp, offset long, head_bytes long, head string"
#: First bytes by which a file is known again.
HEAD = 4096


def _bytes(content: Column) -> Column:
    """One character for each byte, so that positions in the text are positions in the file."""
    return F.decode(content, "ISO-8859-1")


def scan(spark: SparkSession, folder: str, manifest: DataFrame | None = None, pattern: str = "*.jsonl", head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(lines, manifest): what was added to the files of ``folder`` since the scan that left ``manifest``, and the manifest to go on from.

    Lines: path, start (byte of the file where this scan began to read), pos, line (text without its end; empty ones are left out). A last line without an end is left for the next scan, so that each line is read once. A file that
    is shorter than what was read, or that begins with other bytes, is another one under the old name and is read from its start. Files that are gone leave the manifest.

    Only files that changed after the manifest's newest time are opened (the reader skips others by their time; those of the very same time are opened and found unchanged). Store the lines and the manifest as one version
    (``commit_version``): what fails between them is then read again, not lost. A file may hold 2 GB at most; logs are to be rotated below that.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if manifest is None:
        manifest = spark.createDataFrame([], MANIFEST)
    since = manifest.agg(F.max("modified")).first()[0]
    found = files.load(folder)
    if since is not None:
        found = found.where(F.col("modificationTime") >= F.lit(since))
    old = manifest.select("path", "offset", "head_bytes", "head")
    # A file's bytes stay in its row; nothing but paths and numbers is shuffled to find the manifest's row.
    rows = found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    rows = rows.join(F.broadcast(old) if manifest.limit(100_001).count() <= 100_000 else old, "path", "left")
    same = F.col("head").isNotNull() & (F.col("size") >= F.col("offset")) & (F.sha2(F.substring("content", F.lit(1), F.col("head_bytes").cast("int")), 256) == F.col("head"))
    rows = rows.withColumn("start", F.when(same, F.col("offset")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("_new", _bytes(F.substring("content", (F.col("start") + 1).cast("int"), (F.col("size") - F.col("start")).cast("int"))))
    rows = rows.withColumn("_whole", F.length("_new") - F.instr(F.reverse("_new"), "\n") + 1)
    rows = rows.withColumn("_whole", F.when(F.instr("_new", "\n") > 0, F.col("_whole")).otherwise(0))
    each = rows.where("_whole > 0").select("path", "start", F.posexplode(F.split(F.substring("_new", F.lit(1), F.col("_whole") - 1), "\n", -1)).alias("pos", "_line"))
    line = F.decode(F.encode(F.regexp_replace("_line", "\r$", ""), "ISO-8859-1"), "UTF-8")
    lines = each.select("path", "start", "pos", line.alias("line")).where(F.trim("line") != "")
    n = F.least(F.lit(head).cast("long"), F.col("size"))
    changed = rows.select("path", "modified", (F.col("start") + F.col("_whole")).alias("offset"), n.alias("head_bytes"), F.sha2(F.substring("content", F.lit(1), n.cast("int")), 256).alias("head"))
    there = files.load(folder).select("path")
    kept = manifest.join(changed.select("path"), "path", "left_anti").join(there, "path", "left_semi")
    return lines, changed.unionByName(kept.select(*changed.columns))
