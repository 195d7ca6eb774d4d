"""Tables written between steps, and versioned output folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Removes a write's shuffle files when it has ended: what was written is read back, never computed again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares; an own one only in local mode and where none is configured, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialised(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut lineage that outlives lost executors.

    ``by``: a column whose values are written apart, each in a folder of its own below.
    """
    spark = df.sparkSession
    path, was = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", spark.conf.get(CLEAN_UP) if spark.conf.isModifiable(CLEAN_UP) else None
    try:
        if was is not None:
            spark.conf.set(CLEAN_UP, "true")
        df.write.parquet(path, partitionBy=by)
    finally:
        if was is not None:
            spark.conf.set(CLEAN_UP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialised`` that nothing reads any more. What a returned result still reads stays in the shared folder."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_version(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables under a new version, then the pointer to it: readers see all of a version or none."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    counts = [(name, spark.read.parquet(f"{root}/{version}/{name}").count()) for name in tables]
    row = spark.createDataFrame([(version, counts)], "version string, tables array<struct<name:string,rows:long>>")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/_versions")
    return version


def read_version(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest complete version; a table whose rows differ from its pointer is an error."""
    schema = "version string, tables array<struct<name:string,rows:long>>, at timestamp"
    last = spark.read.schema(schema).json(f"{root}/_versions").orderBy(F.desc("at")).first()
    out = {t["name"]: spark.read.parquet(f"{root}/{last['version']}/{t['name']}") for t in last["tables"]}
    for t in last["tables"]:
        if out[t["name"]].count() != t["rows"]:
            raise ValueError(f"table {t['name']} of version {last['version']} is incomplete")
    return out
