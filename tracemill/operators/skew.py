"""Joins of a large table with a smaller one whose keys are unique, where one value may hold a large share of the large table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values held as frequent: those with more than 1 / FREQUENT of the rows, so at most FREQUENT of them are broadcast.
FREQUENT = 5_000
SALTS = 32


def spread_join(large: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", frequent: int = FREQUENT, salts: int = SALTS) -> DataFrame:
    """``large.join(small, on, how)`` for inner and left joins. Rows with a frequent value of column ``by`` (one of ``on``) are dealt over ``salts`` tasks; the rows
    of ``small`` that they may meet are repeated as often. What is frequent is counted over all rows of ``large``."""
    counts = large.groupBy(F.col(by).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    total = large.agg(F.count(F.lit(1)).alias("_total"))
    hot = counts.join(F.broadcast(total), F.col("_n") * frequent > F.col("_total")).where(F.col("_n") >= 1_000).select("_v")
    place = F.when(F.col("_v").isNotNull(), F.pmod(F.xxhash64(*[c for c in large.columns]), F.lit(salts)).cast("int")).otherwise(0)
    left = large.join(F.broadcast(hot), F.col(by) == F.col("_v"), "left").withColumn("_salt", place).drop("_v")
    copies = F.when(F.col("_v").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(F.broadcast(hot), F.col(by) == F.col("_v"), "left").withColumn("_salt", F.explode(copies)).drop("_v")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
