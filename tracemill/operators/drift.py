"""Drift of rollup metrics between two spans of time, and components whose residuals shifted."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .statistics import benjamini_hochberg, distribution_distance, ks_two_sample

# The rollup's columns that a drift report compares.
REPORT_COLUMNS = (
    "error_count", "latency_p50", "latency_p95", "latency_p99", "error_rate", "qps", "mean_call_count_per_request", "max_call_count_per_request", "oracle_violation_rate", "result_schema_diversity", "result_null_rate",
)
EPS = 1e-12
#: Pairs of sizes up to which a Kolmogorov-Smirnov p value is counted exactly.
EXACT = 4_000_000


def within(at: Column, span: str) -> Column:
    """``span``: two times with a comma between them; both ends count."""
    left, right = (F.lit(x.strip()).cast("timestamp") for x in span.split(",", 1))
    return (at >= left) & (at <= right)


def _slot(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Which of ``n`` bins of equal width from lo to hi, the last one closed; null outside. Values at an edge go by the edge itself, not by a rounded quotient."""
    edge = lambda i: lo + i * ((hi - lo) / n)
    i = F.least(F.floor((x - lo) / (hi - lo) * n), n - 1)
    i = F.when(x < edge(i), i - 1).when((x >= edge(i + 1)) & (i < n - 1), i + 1).otherwise(i)
    return F.when((x >= lo) & (x <= hi), i.cast("int"))


def _binned(values: DataFrame, lo: str, hi: str, n: str) -> DataFrame:
    """metric, bin, p (share in the baseline's counts), q (in the window's) for all bins of each metric; ``values`` has metric, value, base and the three named columns."""
    counts = values.select("metric", "base", _slot(F.col("value"), F.col(lo), F.col(hi), F.col(n)).alias("bin")).where("bin is not null").groupBy("metric", "bin").agg(F.count_if("base").alias("r"), F.count_if(~F.col("base")).alias("c"))
    grid = values.groupBy("metric").agg(F.max(n).alias("n")).select("metric", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("bin"))
    both = grid.join(counts, ["metric", "bin"], "left").fillna(0, ["r", "c"])
    whole = Window.partitionBy("metric")  # a bin is a row
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1))
    return both.select("metric", "bin", share("r").alias("p"), share("c").alias("q"))


def drift_report(metrics: DataFrame, baseline: str, window: str, columns: tuple[str, ...] = REPORT_COLUMNS) -> DataFrame:
    """metric, psi, kl_histogram, entropy_divergence, wasserstein, n_baseline, n_window of each of ``columns`` that ``metrics`` (bucket and columns) has.

    ``baseline``, ``window``: spans of buckets. Nulls and values that are not finite don't count; a column without any values has no row, with fewer than two in either span no distances. psi and entropy on ten bins of the
    baseline (half as many as values, two at least), what lies outside drops out; kl_histogram on eleven bins of both (fewer for small baselines).
    """
    there = [c for c in columns if c in metrics.columns]
    if not there:
        return metrics.sparkSession.createDataFrame([], "metric string, psi double, kl_histogram double, entropy_divergence double, wasserstein double, n_baseline long, n_window long")
    base = within(F.col("bucket"), baseline)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in there]))
    # A bucket may be in both spans.
    sides = F.explode(F.filter(F.array(F.when(base, True), F.when(within(F.col("bucket"), window), False)), lambda x: x.isNotNull()))
    rows = metrics.select(sides.alias("base"), *there).select("base", each.alias("x")).select("base", "x.*").where("value is not null AND NOT isnan(value) AND abs(value) < double('infinity')")
    rows = materialised(rows, "drift-values")
    one, two = F.when(F.col("base"), F.col("value")), F.when(~F.col("base"), F.col("value"))
    facts = rows.groupBy("metric").agg(F.count(one).alias("n_baseline"), F.count(two).alias("n_window"), F.min(one).alias("lo"), F.max(one).alias("hi"), F.min("value").alias("all_lo"), F.max("value").alias("all_hi"))
    flat = F.col("lo") == F.col("hi")
    n = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("n_baseline") / 2)))
    m = F.least(F.lit(12), F.greatest(F.lit(3), F.floor(F.sqrt("n_baseline")) + 2)) - 1
    facts = materialised(facts.select("metric", "n_baseline", "n_window", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "all_lo", "all_hi", n.alias("bins"), m.alias("all_bins")), "drift-facts")
    enough = rows.join(F.broadcast(facts.where("n_baseline > 1 AND n_window > 1")), "metric")  # a row for each column
    p, q = F.col("p"), F.col("q")
    shares = _binned(enough, "lo", "hi", "bins")
    sums = shares.groupBy("metric").agg(F.sum((q - p) * F.ln((q + EPS) / (p + EPS))).alias("psi"), F.sum(p + EPS).alias("sp"), F.sum(q + EPS).alias("sq"))
    entropy = shares.join(F.broadcast(sums), "metric").groupBy("metric").agg(F.max("psi").alias("psi"), F.sum((p + EPS) / F.col("sp") * F.ln((p + EPS) / F.col("sp") / ((q + EPS) / F.col("sq")))).alias("entropy_divergence"))
    spread = enough.where("all_lo < all_hi")
    width = facts.select("metric", ((F.col("all_hi") - F.col("all_lo")) / F.col("all_bins")).alias("width"))
    dense = _binned(spread, "all_lo", "all_hi", "all_bins").join(F.broadcast(width), "metric").select("metric", (p / F.col("width") + EPS).alias("p"), (q / F.col("width") + EPS).alias("q"))
    dense = dense.join(F.broadcast(dense.groupBy("metric").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))), "metric")
    kl = dense.groupBy("metric").agg(F.sum(p / F.col("sp") * F.ln(p / F.col("sp") / (q / F.col("sq")))).alias("kl"))
    area = distribution_distance(enough.groupBy("metric", "value").agg(F.count_if("base").alias("r"), F.count_if(~F.col("base")).alias("c")))
    out = facts.join(entropy, "metric", "left").join(kl, "metric", "left").join(area, "metric", "left")
    return out.select("metric", "psi", F.when(F.col("psi").isNotNull(), F.coalesce("kl", F.lit(0.0))).alias("kl_histogram"), "entropy_divergence", "wasserstein", "n_baseline", "n_window")


def exact_ks(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """The two-sample Kolmogorov-Smirnov statistic and its exact two-sided p value for samples without ties: the share of
    orders of both samples whose distribution functions come as far apart. Counted in whole numbers; for more than ``EXACT`` pairs the asymptotic value."""
    if not len(a) or not len(b) or len(a) * len(b) > EXACT:
        return ks_two_sample(a, b)
    n, m = len(a), len(b)
    x = np.concatenate([a, b])
    i, j = np.searchsorted(np.sort(a), x, "right"), np.searchsorted(np.sort(b), x, "right")
    apart = int(np.abs(i.astype(np.int64) * m - j.astype(np.int64) * n).max())
    if not apart:
        return 0.0, 1.0
    # near[j]: orders of the first i and j values that have stayed nearer than that.
    near = np.zeros(m + 1, object)
    near[0] = 1
    for i in range(n + 1):
        lo, hi = max(0, (i * m - apart) // n + 1), min(m, -((-i * m - apart) // n) - 1)
        row = np.zeros(m + 1, object)
        if lo <= hi:
            row[lo : hi + 1] = np.cumsum(near[lo : hi + 1]) if i else 1
        near = row
    return apart / (n * m), float(1 - Fraction(int(near[m]), math.comb(n + m, n)))


def root_causes(metrics: DataFrame, edges: DataFrame, normal: str, incident: str, *, q: float = 0.05, effect: float = 0.2, least: tuple[int, int, int, int] = (30, 20, 10, 10)) -> DataFrame:
    """component, ks, p, p_adjusted, shift, n_fit, n_normal, n_incident, parents, significant: components whose value is no longer what their callers' values say.

    ``metrics``: bucket, component, value (the mean of several counts). ``edges``: src, dst; a component's parents are those that have values in both spans. A linear model is fit on the first two thirds of the normal buckets in which all have values; its
    residuals in the later ones and in the incident are compared by their distribution functions. ``least``: normal, fit, later normal and incident buckets below which a component is left out. Adjusted over all components
    that are tested; significant: p_adjusted at most ``q`` and ks at least ``effect``.

    One component's buckets are one group: a row for each step of time, with its parents' values.
    """
    both = F.explode(F.filter(F.array(F.when(within(F.col("bucket"), normal), False), F.when(within(F.col("bucket"), incident), True)), lambda x: x.isNotNull()))
    series = metrics.where("value is not null").select("bucket", "component", "value", both.alias("incident")).groupBy("component", "incident", "bucket").agg(F.avg("value").alias("value"))
    series = materialised(series, "cause-series")
    whole = series.groupBy("component").agg(F.countDistinct("incident").alias("n")).where("n = 2").select("component")
    links = edges.select("src", "dst").distinct().join(whole.select(F.col("component").alias("src")), "src").join(whole.select(F.col("component").alias("dst")), "dst")
    parents = links.groupBy(F.col("dst").alias("component")).agg(F.array_sort(F.collect_list("src")).alias("parents"))
    above = series.select(F.col("component").alias("src"), "incident", "bucket", F.col("value").alias("x"))
    values = links.withColumnRenamed("dst", "component").join(above, "src").groupBy("component", "incident", "bucket").agg(F.array_sort(F.collect_list(F.struct("src", "x"))).alias("xs"))
    frames = series.join(values, ["component", "incident", "bucket"]).join(parents, "component").where(F.size("xs") == F.size("parents")).select("component", "incident", "bucket", "value", F.col("xs.x").alias("xs"), "parents")
    n_normal, n_fit, n_late, n_bad = least

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype=object) for c in ("component", "ks", "p", "shift", "n_fit", "n_normal", "n_incident", "parents")})
        pdf = pdf.sort_values("bucket")
        bad = pdf["incident"].to_numpy(bool)
        total = int((~bad).sum())
        cut = max(n_fit, int(total * 2 / 3))
        if total < n_normal or total - cut < n_late or int(bad.sum()) < n_bad:
            return empty
        x, y = np.array([[1.0, *v] for v in pdf["xs"]], float), pdf["value"].to_numpy(float)
        good = np.flatnonzero(~bad)
        rest = y - x @ np.linalg.lstsq(x[good[:cut]], y[good[:cut]], rcond=None)[0]
        late, now = rest[good[cut:]], rest[bad]
        ks, p = exact_ks(late, now)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "ks": [ks], "p": [p], "shift": [float(now.mean() - late.mean())], "n_fit": [cut], "n_normal": [len(late)], "n_incident": [len(now)], "parents": [list(pdf["parents"].iloc[0])]})

    tested = materialised(frames.groupBy("component").applyInPandas(test, "component string, ks double, p double, shift double, n_fit long, n_normal long, n_incident long, parents array<string>"), "causes")
    adjusted = benjamini_hochberg(tested).withColumnRenamed("q", "p_adjusted")
    return adjusted.select("component", "ks", "p", "p_adjusted", "shift", "n_fit", "n_normal", "n_incident", "parents", ((F.col("p_adjusted") <= q) & (F.col("ks") >= effect)).alias("significant"))
