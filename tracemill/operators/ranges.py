"""Running numbers over sorted ranges, for groups that are too large for one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .skew import spread_join


def numbered(df: DataFrame, by: list[str], order: list[Column | str], place: str = "place", sums: dict[str, str] | None = None, label: str = "ranges") -> DataFrame:
    """``df`` with each row's ``place`` (from 1) in its group and, for each ``{new: column}`` of ``sums``, the sum up to and with the row.

    Rows are sorted into ranges of (group, order) and numbered within each; then what the ranges before hold of the same group is added. A
    group that holds most of all rows is spread over as many ranges. Rows that are equal in group and order stay together.
    """
    sums = sums or {}
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = materialised(df.repartitionByRange(*[F.col(c) for c in by], *keys).withColumn("_range", F.spark_partition_id()), label)
    upto = Window.partitionBy("_range", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.select("*", F.count(F.lit(1)).over(upto).alias(place), *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    parts = ranges.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range that goes on with the group of the one before: fewer than there are ranges.
    names = ["_c", *[f"_s{i}" for i in range(len(sums))]]
    offsets = parts.select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[F.sum(c).over(earlier).alias(f"_before{c}") for c in names]).where("_before_c is not null")
    same = reduce(lambda x, y: x & y, [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]])
    rows = rows.join(F.broadcast(offsets), same, "left")
    more = {place: "_before_c"} | {n: f"_before_s{i}" for i, n in enumerate(sums)}
    return rows.select(*[F.col(c) for c in df.columns], *[(F.col(n) + F.coalesce(b, F.lit(0))).alias(n) for n, b in more.items()])


def medians(df: DataFrame, by: list[str], value: str, name: str = "median", label: str = "medians") -> DataFrame:
    """(``by``…, n, ``name``): the exact median of non-null values of each group, the mean of the middle two where their number is even. No group is held in one task."""
    ranked = numbered(df.where(F.col(value).isNotNull()).select(*by, value), by, [value], "_place", label=label)
    sizes = ranked.groupBy(*by).agg(F.max("_place").alias("n"))
    # Two rows of each group lie in the middle; the sizes go to the rows by the place they name.
    middle = sizes.select(*by, "n", F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("_place"))
    same = reduce(lambda x, y: x & y, [F.col("_place") == F.col("_middle"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]])
    found = ranked.join(middle.select(F.col("_place").alias("_middle"), "n", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]), same)
    return found.groupBy(*by).agg(F.max("n").alias("n"), F.avg(value).alias(name))


def order_statistics(df: DataFrame, by: list[str], value: str, picks: dict[str, Callable[[Column], Column]], label: str = "order-statistics") -> DataFrame:
    """(``by``…, n and a column for each of ``picks``): of each group's n non-null values in order the one at the index (from 0) that the pick gives for n.

    Equal values are one row with their number, so that a group is as large as it has different values; these are spread over ranges. Groups with a null in ``by`` have no row.
    """
    counts = df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*by, value]])).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = materialised(numbered(counts, by, [value], "_place", {"_upto": "_n"}, label), label)
    sizes = run.groupBy(*by).agg(F.max("_upto").alias("n"))
    wanted = sizes.select("*", *[pick(F.col("n")).cast("long").alias(f"_i{k}") for k, pick in enumerate(picks.values())])
    both = spread_join(run, wanted, by, by[0])
    here = lambda k: (F.col(f"_i{k}") < F.col("_upto")) & (F.col(f"_i{k}") >= F.col("_upto") - F.col("_n"))
    return both.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(here(k), F.col(value))).alias(name) for k, name in enumerate(picks)])
