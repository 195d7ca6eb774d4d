"""Confidence intervals by resampling: draws are weights computed from (decision, draw), so that all of them are sums of one pass."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .ranges import numbered

_PRIME = 2**31 - 1

# Coefficients of Acklam's rational approximation to the normal quantile (relative error below 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile; null outside (0, 1)."""
    tail = lambda q: _horner(_C, q) / _horner((*_D, 1.0), q)
    far = lambda x: F.sqrt(-2 * F.ln(x))
    mid = p - 0.5
    return F.when((p <= 0) | (p >= 1), None).when(p < _TAIL, tail(far(p))).when(p > 1 - _TAIL, -tail(far(1 - p))).otherwise(_horner(_A, mid * mid) * mid / _horner((*_B, 1.0), mid * mid))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution by the series x + x^3 / 3 + x^5 / 15 …, exact to some 1e-15 within 7 and 0 or 1 beyond."""
    step = lambda acc, k: F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * x * x / (2 * k + 1)).alias("t"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(F.lit(0.0).alias("s"), x.cast("double").alias("t")), step)["s"]
    return F.when(x < -7, 0.0).when(x > 7, 1.0).otherwise(0.5 + total * F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5)


def halves(samples: DataFrame, by: list[str]) -> DataFrame:
    """``samples`` with ``fold`` 0 or 1: every second one of each group of ``by`` in the order of the decisions' hashes. Groups of any size are numbered over ranges."""
    marked = samples.withColumn("_h", F.sha2(F.col("decision_id").cast("string"), 256))
    return numbered(marked, by, ["_h"], "_place", label="folds").withColumn("fold", ((F.col("_place") - 1) % 2).cast("int")).drop("_h", "_place")


def with_draws(rows: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """Each row once for each draw with its ``weight``, a Poisson(1) number, where that is not 0; and once with draw -1 and weight 1.

    Draw b gives the row with hash h the uniform number ((a_b h + c_b) mod p) / p: rows are independent in pairs within a draw, draws of each other.
    """
    numbers = [int(hashlib.md5(f"{seed}|{b}".encode()).hexdigest()[:15], 16) for b in range(draws)]
    listed = lambda values: F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")
    a, c = listed([1 + n % (_PRIME - 1) for n in numbers]), listed([n // _PRIME % _PRIME for n in numbers])
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % _PRIME
    each = rows.withColumn("_h", h).withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    u = ((F.col("_h") * F.get(a, F.col("draw")) + F.get(c, F.col("draw"))) % _PRIME) / float(_PRIME)
    upto, weight = 0.0, F.lit(0)
    for k in range(13):
        upto += exp(-1) / factorial(k)
        weight = weight + (F.col("_u") >= upto).cast("int")
    each = each.withColumn("_u", u).withColumn("weight", F.when(F.col("draw") < 0, 1).otherwise(weight))
    return each.where("weight > 0").drop("_h", "_u")


def draw_sums(rows: DataFrame, key: str, values: list[str], draws: int, seed: int = 0) -> DataFrame:
    """(draw, ``values``…): the sums of ``with_draws`` over its weights, added up from blocks of rows, each as one product of weights and values."""
    numbers = [int(hashlib.md5(f"{seed}|{b}".encode()).hexdigest()[:15], 16) for b in range(draws)]
    block = max(1, 1_000_000 // max(1, draws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = (np.array(x, dtype=np.int64) for x in ([1 + n % (_PRIME - 1) for n in numbers], [n // _PRIME % _PRIME for n in numbers]))
        steps = np.cumsum([exp(-1) / factorial(k) for k in range(13)])
        total = np.zeros((draws + 1, len(values)))  # the sample itself first
        for batch in batches:
            hashes, columns = batch.column("_h").to_numpy(zero_copy_only=False), np.column_stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values])
            for k in range(0, len(hashes), block):
                h, x = hashes[k : k + block, None], columns[k : k + block]
                weight = np.searchsorted(steps, (h * a + c) % _PRIME / float(_PRIME), side="right")
                weight[h[:, 0] < 0] = 0  # a row without a key is in no draw
                plain = np.isfinite(x).all(axis=1)
                total[0] += x.sum(axis=0)
                total[1:] += weight[plain].T.astype(float) @ x[plain]
                for w, v in zip(weight[~plain], x[~plain], strict=True):
                    total[1:][w > 0] += w[w > 0, None] * v
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, draws), pa.int32()), *map(pa.array, np.ascontiguousarray(total.T))], names=["draw", *values])

    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % _PRIME
    parts = rows.select(F.coalesce(h, F.lit(-1)).alias("_h"), *values).mapInArrow(run, ", ".join(["draw int", *[f"{v} double" for v in values]]))
    return parts.groupBy("draw").agg(*[F.sum(v).alias(v) for v in values])


def _parts(baseline: int, target: int) -> dict[str, Column]:
    """What a sample of weight 1 adds to the sums that both values are made of."""
    out = {}
    for f in (0, 1):
        here = F.col("fold") == f
        out |= {f"w{f}": F.when(here, 1.0), f"y{f}": F.when(here, F.col("reward"))}
        for name, action in (("b", baseline), ("t", target)):
            mine = here & (F.col("action") == action)
            out |= {f"w{f}{name}": F.when(mine, 1.0), f"y{f}{name}": F.when(mine, F.col("reward")), f"v{f}{name}": F.when(mine, 1 / F.col("propensity")), f"u{f}{name}": F.when(mine, F.col("reward") / F.col("propensity"))}
    return {n: F.coalesce(c, F.lit(0.0)) for n, c in out.items()}


def _value(name: str, part) -> Column:
    """The doubly robust value of an action from its sums: each half is predicted from the other one's mean of the action, else of all actions, else 0."""
    total = F.lit(0.0)
    for f in (0, 1):
        g = 1 - f
        # A sum that is left over when all its samples are left out is not exactly 0.
        q = F.when(part(f"w{g}{name}") > 0.5, part(f"y{g}{name}") / part(f"w{g}{name}")).when(part(f"w{g}") > 0.5, part(f"y{g}") / part(f"w{g}")).otherwise(0.0)
        total = total + part(f"w{f}") * q + part(f"u{f}{name}") - q * part(f"v{f}{name}")
    return total / (part("w0") + part("w1"))


def bootstrap_values(samples: DataFrame, baseline: int, target: int, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(draw, dr, delta): the target's doubly robust value and what it is above the baseline's, in each draw; draw -1 is the sample itself.

    ``samples``: decision_id, action, propensity, reward. Decisions keep the half of the cross-fit that they have in the whole sample.
    """
    parts = _parts(baseline, target)
    rows = halves(samples.select("decision_id", "action", "propensity", "reward"), ["action"]).select("decision_id", *[c.alias(n) for n, c in parts.items()])
    sums = draw_sums(rows, "decision_id", list(parts), draws, seed)
    return sums.where("w0 + w1 > 0").select("draw", _value("t", F.col).alias("dr"), (_value("t", F.col) - _value("b", F.col)).alias("delta"))


def bootstrap_delta(samples: DataFrame, baseline: int, target: int, draws: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: n, delta, low and high of its bias-corrected and accelerated interval, plain_low and plain_high of the percentile interval, below (draws below delta), z0, accel, dr, dr_low, dr_high (percentiles of the target's value).

    The acceleration leaves out each decision once; what is left is a difference of sums, so this is one more pass. No samples: no row.
    """
    parts = _parts(baseline, target)
    rows = materialised(halves(samples.select("decision_id", "action", "propensity", "reward"), ["action"]).select("decision_id", *[c.alias(n) for n, c in parts.items()]), "fold-parts")
    whole = rows.agg(F.count("*").alias("n"), *[F.sum(n).alias(f"all_{n}") for n in parts])
    without = lambda n: F.col(f"all_{n}") - F.col(n)
    full = lambda n: F.col(f"all_{n}")
    off = (_value("t", without) - _value("b", without)) - (_value("t", full) - _value("b", full))
    left = rows.join(F.broadcast(whole)).where("n > 1").select(off.alias("d")).agg(F.count("d").alias("k"), F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.sum(F.col("d") * F.col("d") * F.col("d")).alias("s3"))
    mean = F.col("s1") / F.col("k")
    cube = F.col("s3") - 3 * mean * F.col("s2") + 3 * mean * mean * F.col("s1") - F.col("k") * mean * mean * mean
    square = F.col("s2") - mean * F.col("s1")
    accel = F.when(square > 1e-300, -cube / (6 * F.pow(square, F.lit(1.5)))).otherwise(0.0)
    sums = draw_sums(rows, "decision_id", list(parts), draws, seed)
    values = sums.where("w0 + w1 > 0").select("draw", _value("t", F.col).alias("dr"), (_value("t", F.col) - _value("b", F.col)).alias("delta"))
    point = F.max(F.when(F.col("draw") < 0, F.col("delta")))
    drawn = lambda c: F.sort_array(F.collect_list(F.when(F.col("draw") >= 0, F.col(c))))  # noqa: E731  # as many as there are draws
    row = values.agg(point.alias("delta"), F.max(F.when(F.col("draw") < 0, F.col("dr"))).alias("dr"), drawn("delta").alias("v"), drawn("dr").alias("w"))
    row = row.where("delta is not null").join(F.broadcast(left)).join(F.broadcast(whole.select("n")))
    below = F.size(F.filter("v", lambda x: x < F.col("delta")))
    size = F.size("v")
    row = row.withColumn("below", below).withColumn("z0", normal_quantile(F.least(F.greatest(below / size, 1 / (size + 1)), 1 - 1 / (size + 1)))).withColumn("accel", F.coalesce(accel, F.lit(0.0)))
    at = lambda v, share: F.get(v, F.least(size - 1, F.greatest(F.lit(0), F.floor(share * (size - 1)).cast("int"))))

    def end(level: float) -> Column:
        z = F.col("z0") + normal_quantile(F.lit(level))
        return at(F.col("v"), F.when(1 - F.col("accel") * z > 0, normal_cdf(F.col("z0") + z / (1 - F.col("accel") * z))).otherwise(level))

    low, high = alpha / 2, 1 - alpha / 2
    return row.select("n", "delta", end(low).alias("low"), end(high).alias("high"), at(F.col("v"), F.lit(low)).alias("plain_low"), at(F.col("v"), F.lit(high)).alias("plain_high"), "below", "z0", "accel", "dr", at(F.col("w"), F.lit(low)).alias("dr_low"), at(F.col("w"), F.lit(high)).alias("dr_high"))


def bootstrap_mean(rows: DataFrame, key: str, value: str, draws: int = 5000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row for paired differences ``value`` of ``key`` (a question's gain of one run over another): mean, low, high (interpolated percentiles of the draws), win_rate, loss_rate."""
    rows = rows.select(F.col(key), F.col(value).cast("double").alias("_x"))
    sums = with_draws(rows, key, draws, seed).groupBy("draw").agg((F.sum(F.col("_x") * F.col("weight")) / F.sum("weight")).alias("m"))
    ends = sums.where("draw >= 0").agg(F.expr(f"percentile(m, {alpha / 2})").alias("low"), F.expr(f"percentile(m, {1 - alpha / 2})").alias("high"))  # of the draws
    return rows.agg(F.avg("_x").alias("mean"), F.avg((F.col("_x") > 0).cast("double")).alias("win_rate"), F.avg((F.col("_x") < 0).cast("double")).alias("loss_rate")).join(F.broadcast(ends)).select("mean", "low", "high", "win_rate", "loss_rate")
