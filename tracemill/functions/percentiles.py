"""The four percentile definitions that the analyses use. They differ on small samples, so each has its own name.

The aggregates of three of them hold a group's values in one array: they are for small groups. Their ``…_at`` give the place in a sorted sample of n for ``ranges.order_statistics``, which takes groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolated(x: Column, p: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    return F.percentile(x, F.lit(p))


def floor_index(x: Column, p: float) -> Column:
    """The value at index floor(p * (n - 1)) of the sorted sample."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.floor(F.lit(p) * (F.size(values) - 1)).cast("int"))


def floor_index_at(p: float):
    return lambda n: F.floor(F.lit(p) * (n - 1))


def clamped_index_at(p: float):
    return lambda n: F.least(F.floor(n * F.lit(p)), n - 1)


def nearest_rank_at(p: float):
    return lambda n: F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0))


def clamped_index(x: Column, p: float) -> Column:
    """The value at index floor(n * p), at most n - 1, of the sorted sample."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.least(F.floor(F.size(values) * F.lit(p)), F.size(values) - F.lit(1)).cast("int"))


def nearest_rank(x: Column, p: float) -> Column:
    """The value of rank ceil(p * n): the discrete percentile."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.greatest(F.ceil(F.size(values) * F.lit(p)) - 1, F.lit(0)).cast("int"))


def mad(x: Column) -> Column:
    """Median absolute deviation, scaled to a normal's standard deviation."""
    values = F.collect_list(x)
    centre = F.percentile(x, F.lit(0.5))
    return MAD_SCALE * median_of(F.transform(values, lambda v: F.abs(v - centre)))


#: Makes the median absolute deviation of a normal sample estimate its standard deviation.
MAD_SCALE = 1.4826


def median_of(values: Column) -> Column:
    """Median of an array."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2
