"""Drift, trend, learning and policy statistics.

Small-sample fits run per group in ``applyInPandas``; a group there is one metric series or one arm's sample, never a whole table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .intervals import halves
from .ranges import numbered

EPS = 1e-12


def _bins(reference: DataFrame, value: str, most: int) -> DataFrame:
    return reference.groupBy("metric").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.count(value) / 2))).cast("int").alias("bins"))


def _slot(x: Column) -> Column:
    """Half-open bins of equal width, the last one closed; null outside."""
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return F.when((x >= F.col("lo")) & (x <= F.col("hi")), F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width), F.col("bins") - 1)).otherwise(F.lit(0)).cast("int"))


def psi(reference: DataFrame, current: DataFrame, most: int = 10) -> DataFrame:
    """Population stability index of (metric, value); bins from the reference, values outside them drop out."""
    edges = _bins(reference.where("value is not null"), "value", most)

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.join(edges, "metric").select("metric", _slot(F.col("value")).alias("bin")).where("bin is not null").groupBy("metric", "bin").agg(F.count("*").alias(name))

    grid = edges.select("metric", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    both = grid.join(counts(reference, "r"), ["metric", "bin"], "left").join(counts(current, "c"), ["metric", "bin"], "left").fillna(0, ["r", "c"])
    w = Window.partitionBy("metric")
    p = F.greatest(F.col("r") / F.greatest(F.sum("r").over(w), F.lit(1)), F.lit(EPS))
    q = F.greatest(F.col("c") / F.greatest(F.sum("c").over(w), F.lit(1)), F.lit(EPS))
    return both.select("metric", p.alias("p"), q.alias("q")).groupBy("metric").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def binned_kl(reference: DataFrame, current: DataFrame, bins: int = 12) -> DataFrame:
    """Kullback-Leibler divergence of the current from the reference on bins over both ranges."""
    both = reference.select("metric", "value", F.lit(1).alias("r")).union(current.select("metric", "value", F.lit(0).alias("r"))).where("value is not null")
    edges = both.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.lit(bins).alias("bins"))
    counted = both.join(edges, "metric").select("metric", "r", _slot(F.col("value")).alias("bin")).groupBy("metric", "bin").agg(F.sum("r").alias("r"), F.sum(1 - F.col("r")).alias("c"))
    w = Window.partitionBy("metric")
    p, q = (F.greatest(F.col(x) / F.greatest(F.sum(x).over(w), F.lit(1)), F.lit(EPS)) for x in ("r", "c"))
    return counted.select("metric", p.alias("p"), q.alias("q")).groupBy("metric").agg(F.sum(F.col("q") * F.log(F.col("q") / F.col("p"))).alias("kl"))


def wasserstein(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Area between the two distribution functions of each metric."""
    both = reference.select("metric", "value", F.lit(1).alias("r"), F.lit(0).alias("c")).union(current.select("metric", "value", F.lit(0).alias("r"), F.lit(1).alias("c"))).where("value is not null")
    return distribution_distance(both.groupBy("metric", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c")))


def distribution_distance(points: DataFrame) -> DataFrame:
    """(metric, wasserstein): the area between two distribution functions. ``points``: metric, value, r, c (how often in either sample), one row a value. Sums run over sorted ranges."""
    run = materialised(numbered(points, ["metric"], ["value"], "_place", {"upto_r": "r", "upto_c": "c"}, "distribution"), "distribution")
    whole = run.groupBy("metric").agg(F.max("upto_r").alias("nr"), F.max("upto_c").alias("nc"))
    after = run.select("metric", (F.col("_place") - 1).alias("_place"), F.col("value").alias("next"))
    gap = F.abs(F.col("upto_r") / F.col("nr") - F.col("upto_c") / F.col("nc")) * (F.col("next") - F.col("value"))
    out = run.join(after, ["metric", "_place"]).join(whole, "metric").groupBy("metric").agg(F.sum(gap).alias("wasserstein"))
    return whole.select("metric").join(out, "metric", "left").fillna(0.0, ["wasserstein"])


def theil_sen(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The median of all slopes between two points of a series, over their index. A series is one key's sessions."""
    w = Window.partitionBy(key).orderBy(order)
    points = series.select(key, (F.row_number().over(w) - 1).alias("i"), F.col(value).cast("double").alias("y"))
    other = points.select(key, F.col("i").alias("j"), F.col("y").alias("z"))
    slopes = points.join(other, key).where("i < j").select(key, ((F.col("z") - F.col("y")) / (F.col("j") - F.col("i"))).alias("slope"))
    return slopes.groupBy(key).agg(F.percentile("slope", F.lit(0.5)).alias("slope"), F.count("*").alias("pairs"))


def memory_trends(sessions: DataFrame, least: int = 3) -> DataFrame:
    """Components that kept memory in each of at least so many sessions, ever more of it."""
    enough = sessions.groupBy("component").agg(F.count("*").alias("sessions"), F.min("bytes").alias("least_bytes")).where((F.col("sessions") >= least) & (F.col("least_bytes") > 0))
    return theil_sen(sessions.join(enough, "component"), "component", "session_id", "bytes").where("slope > 0").join(enough, "component")


def relative_spread(timings: DataFrame, key: str, value: str) -> DataFrame:
    """The median over keys of the scaled median deviation relative to the median."""
    each = timings.groupBy(key).agg(F.collect_list(value).alias("v"), F.percentile(value, F.lit(0.5)).alias("m")).where("m > 0")
    from ..functions.percentiles import MAD_SCALE, median_of

    spread = MAD_SCALE * median_of(F.transform("v", lambda x: F.abs(x - F.col("m")))) / F.col("m")
    return each.select(spread.alias("s")).agg(F.percentile("s", F.lit(0.5)).alias("spread"))


def leave_one_out_outliers(points: DataFrame, key: str, name: str, value: str, factor: float = 3.0) -> DataFrame:
    """Members whose value is at least the factor times the median of the others, and out of their deviation band if there are three."""
    others = points.select(key, F.col(name).alias("_n"), F.col(value).alias("_v"))
    both = points.join(others, key).where(F.col(name) != F.col("_n")).groupBy(key, name, value).agg(F.collect_list("_v").alias("v"), F.percentile("_v", F.lit(0.5)).alias("median"))
    from ..functions.percentiles import MAD_SCALE, median_of

    band = MAD_SCALE * median_of(F.transform("v", lambda x: F.abs(x - F.col("median"))))
    return both.where((F.col(value) >= factor * F.col("median")) & ((F.size("v") < 3) | (F.col(value) > F.col("median") + factor * band))).select(key, name, value, "median")


def benjamini_hochberg(tests: DataFrame, key: str = "component") -> DataFrame:
    """Adjusted p values: the least of n p / rank over all larger p. Ranges of p are sorted apart; their sizes and minima link them."""
    ranges = materialised(tests.repartitionByRange("p", key).withColumn("_range", F.spark_partition_id()), "p-ranges")
    order, across = Window.partitionBy("_range").orderBy("p", key), Window.orderBy("_range")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_c"))  # one row for each range
    offsets = sizes.select("_range", (F.sum("_c").over(across) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = ranges.join(F.broadcast(offsets), "_range").withColumn("_raw", F.col("p") * F.col("_n") / (F.col("_before") + F.row_number().over(order)))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy("_range").agg(F.min("_raw").alias("_m")).select("_range", F.min("_m").over(later).alias("_later"))
    back = Window.partitionBy("_range").orderBy(F.desc("p"), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_raw").over(back), F.col("_later"))  # least takes no notice of a null
    return ranked.join(F.broadcast(least), "_range").withColumn("q", q).drop("_range", "_before", "_n", "_raw", "_later")


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Kolmogorov-Smirnov statistic of two samples and its asymptotic p value."""
    if not len(a) or not len(b):
        return 0.0, 1.0
    x = np.concatenate([a, b])
    d = float(np.abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)).max())
    n = math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    t = (n + 0.12 + 0.11 / n) * d
    p = 1.0 if t < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))
    return d, float(min(1.0, max(0.0, p)))


def residual_shift(frames: DataFrame, early: float = 2 / 3) -> DataFrame:
    """Per component: fit it on its parents over early normal buckets, and test its residuals in the incident against late normal ones.

    ``frames``: component, bucket, incident (boolean), value, parents (array of the parents' values). One component's buckets are a group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("bucket")
        pdf = pdf[[all(v is not None and v == v for v in p) for p in pdf["parents"]]]
        x = np.array([[1.0, *p] for p in pdf["parents"]], float).reshape(len(pdf), -1)
        y, bad = pdf["value"].to_numpy(float), pdf["incident"].to_numpy(bool)
        normal = np.flatnonzero(~bad)
        cut = max(1, int(len(normal) * early))
        fit = np.linalg.lstsq(x[normal[:cut]], y[normal[:cut]], rcond=None)[0] if len(normal) else np.zeros(x.shape[1])
        r = y - x @ fit
        d, p = ks_two_sample(r[normal[cut:]], r[bad])
        return pd.DataFrame({"component": [pdf["component"].iloc[0]] if len(pdf) else [], "ks": [d] if len(pdf) else [], "p": [p] if len(pdf) else [], "shift": [float(r[bad].mean() - r[normal].mean()) if bad.any() and len(normal) else 0.0] if len(pdf) else []})

    return frames.groupBy("component").applyInPandas(run, "component string, ks double, p double, shift double")


def usl_fit(points: DataFrame) -> DataFrame:
    """Universal scalability law of (key, concurrency, req_per_s): least squares over a refined grid with the rate in closed form.

    Points without concurrency or throughput don't count. All results are null for fewer than three concurrencies, a flat sweep, or a
    fit no better than the mean. Both coefficients lie between 0 and 1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, t = pdf["concurrency"].to_numpy(float), pdf["req_per_s"].to_numpy(float)
        some = (n >= 1) & (t > 0)
        n, t = n[some], t[some]
        out = {"key": [pdf["key"].iloc[0]], "sigma": [None], "kappa": [None], "rate": [None], "r2": [None], "peak": [None]}
        spread = float(((t - t.mean()) ** 2).sum()) if len(t) else 0.0
        if len(np.unique(n)) >= 3 and spread > 0:
            (s0, s1), (k0, k1), best = (0.0, 1.0), (0.0, 1.0), None
            for _ in range(24):
                s, k = np.linspace(s0, s1, 33)[:, None, None], np.linspace(k0, k1, 33)[None, :, None]
                f = n / (1 + s * (n - 1) + k * n * (n - 1))
                rate = (f * t).sum(-1) / (f * f).sum(-1)
                err = ((t - rate[..., None] * f) ** 2).sum(-1)
                i, j = np.unravel_index(err.argmin(), err.shape)
                if best is None or err[i, j] < best[3]:
                    best = float(s[i, 0, 0]), float(k[0, j, 0]), float(rate[i, j]), float(err[i, j])
                ds, dk = (s1 - s0) / 4, (k1 - k0) / 4
                (s0, s1), (k0, k1) = (max(0.0, best[0] - ds), min(1.0, best[0] + ds)), (max(0.0, best[1] - dk), min(1.0, best[1] + dk))
            r2 = 1 - best[3] / spread
            if best[2] > 0 and r2 > 0:
                out |= {"sigma": [best[0]], "kappa": [best[1]], "rate": [best[2]], "r2": [r2], "peak": [math.sqrt((1 - best[0]) / best[1]) if best[1] > 0 and best[0] < 1 else None]}
        return pd.DataFrame(out)

    return points.groupBy("key").applyInPandas(run, "key string, sigma double, kappa double, rate double, r2 double, peak double")


def bootstrap_improvement(pairs: DataFrame, resamples: int = 2000, seed: int = 1729, least: float = 0.10) -> DataFrame:
    """Median relative improvement of (key, before, after) with a percentile interval from seeded resampling of each key's pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, a = pdf["before"].to_numpy(float), pdf["after"].to_numpy(float)
        rel = np.where(b != 0, (b - a) / np.where(b == 0, 1, b), 0.0)
        rng = np.random.default_rng(seed)
        meds = np.sort(np.median(rel[rng.integers(0, len(rel), (resamples, len(rel)))], axis=1))
        lo, hi = meds[int(0.025 * (resamples - 1))], meds[int(0.975 * (resamples - 1))]
        m = float(np.median(rel))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "improvement": [m], "low": [float(lo)], "high": [float(hi)], "verdict": ["proven" if lo > 0 and m >= least else "regressed" if hi < 0 else "inconclusive"]})

    return pairs.groupBy("key").applyInPandas(run, "key string, improvement double, low double, high double, verdict string")


def laplace(successes: Column, trials: Column) -> Column:
    return (successes + 1) / (trials + 2)


def chance_probability(kind: Column, n: Column, k: Column) -> Column:
    """How likely an invariant of its kind would hold by chance."""
    return F.when(kind == "numeric_bound", 2 / (n + 1)).when(kind == "stable_enum", k / n).otherwise(F.pow(F.lit(2.0), -n))


def learned_invariants(fields: DataFrame, least: int = 5, chance: float = 0.10, most_values: int = 8) -> DataFrame:
    """From (endpoint, field, text, number, seq) of healthy responses: never null, few values, bounds, rising ids; with what enforces.

    Numbers rise if they do within each range of the rows in order, and from each range to the next; so no field is held in one task.
    """
    by = ["endpoint", "field"]
    counts = fields.groupBy(*by, "text").agg(F.count("*").alias("n"), F.count("number").alias("numbers"), F.min("number").alias("low"), F.max("number").alias("high"))
    g = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("text").alias("kinds"), F.sum("numbers").alias("numbers"), F.min("low").alias("low"), F.max("high").alias("high"))
    ranges = fields.where("number is not null").select(*by, "seq", "number").repartitionByRange(*by, "seq").withColumn("_range", F.spark_partition_id())
    before = F.lag("number").over(Window.partitionBy("_range", *by).orderBy("seq"))
    parts = ranges.withColumn("_up", F.coalesce(F.col("number") > before, F.lit(True))).groupBy("_range", *by).agg(F.min("_up").alias("_up"), F.min_by("number", F.struct("seq")).alias("_first"), F.max_by("number", F.struct("seq")).alias("_last"))
    # A row for each range and field.
    last = F.lag("_last").over(Window.partitionBy(*by).orderBy("_range"))
    rising = parts.withColumn("_up", F.col("_up") & F.coalesce(F.col("_first") > last, F.lit(True))).groupBy(*by).agg(F.min("_up").alias("rises"))
    g = g.alias("g").join(rising.alias("r"), reduce(lambda x, y: x & y, [F.col(f"g.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]), "left").select("g.*", "rises")
    g = g.where(F.col("n") >= least)
    found = F.array_compact(F.array(
        F.when(F.col("nulls") == 0, "never_null"), F.when(F.col("kinds").between(2, most_values) & (F.col("nulls") == 0), "stable_enum"),
        F.when((F.col("numbers") == F.col("n")) & (F.col("low") < F.col("high")), "numeric_bound"), F.when((F.col("numbers") == F.col("n")) & F.col("rises") & F.col("field").rlike("(^|_)id$"), "id_monotonic")))
    out = g.select("endpoint", "field", "n", "kinds", "low", "high", F.explode(found).alias("kind"))
    p = chance_probability(F.col("kind"), F.col("n"), F.col("kinds"))
    return out.withColumn("confidence", laplace(F.col("n"), F.col("n"))).withColumn("chance", p).withColumn("enforced", p <= chance)


def policy_samples(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Decisions with a usable propensity and their reward of the best source: explicit, critic, auxiliary, implicit."""
    order = F.expr("array_position(array('explicit', 'critic', 'auxiliary', 'implicit'), coalesce(source, 'explicit'))")
    reward = feedback.groupBy("decision_id").agg(F.min_by("reward", F.struct(order, -F.col("seq"))).alias("reward"))
    ok = ~F.coalesce("fallback", F.lit(False)) & (F.col("propensity") > 0) & (F.col("propensity") <= 1)
    return decisions.where(ok).join(reward, "decision_id").where("reward is not null").select("decision_id", "action", "propensity", "reward", "epoch")


def off_policy(samples: DataFrame, target: int, clip: float | None = None) -> DataFrame:
    """Direct, weighted, self-normalised and doubly robust value of always taking ``target``, cross-fitted on two stratified halves."""
    s = materialised(halves(samples, ["action"]), "folds")
    model = s.groupBy((1 - F.col("fold")).alias("fold"), "action").agg(F.avg("reward").alias("mean"))
    overall = s.groupBy((1 - F.col("fold")).alias("fold")).agg(F.avg("reward").alias("overall"))
    at = model.where(F.col("action") == target).select("fold", F.col("mean").alias("_target"))
    own = model.select("fold", "action", F.col("mean").alias("_own"))
    rows = s.join(F.broadcast(overall), "fold", "left").join(F.broadcast(at), "fold", "left").join(own, ["fold", "action"], "left")
    weight = F.when(F.col("action") == target, 1 / F.col("propensity")).otherwise(F.lit(0.0))
    if clip:
        weight = F.least(weight, F.lit(float(clip)))
    rows = rows.select("reward", weight.alias("w"), F.coalesce("_target", "overall", F.lit(0.0)).alias("q"), F.coalesce("_own", "overall", F.lit(0.0)).alias("qa"))
    total = F.sum("w")
    return rows.agg(
        F.count("*").alias("n"), F.avg("q").alias("dm"), F.avg(F.col("w") * F.col("reward")).alias("ips"), F.when(total > 0, F.sum(F.col("w") * F.col("reward")) / total).alias("snips"),
        F.avg(F.col("q") + F.col("w") * (F.col("reward") - F.col("qa"))).alias("dr"), F.when(F.sum(F.col("w") * F.col("w")) > 0, total * total / F.sum(F.col("w") * F.col("w"))).otherwise(F.lit(0.0)).alias("ess"))


def bernstein_bound(mean: Column, variance: Column, n: Column, delta: float = 0.1) -> Column:
    """Empirical Bernstein lower bound of rewards with a range of 2."""
    log = math.log(3 / delta)
    return F.when(n > 0, mean - F.sqrt(2 * variance * log / n) - 3 * 2 * log / n)


def shrunk_mean(mean: Column, n: Column, overall: Column, prior: float = 2.0) -> Column:
    return (n * mean + prior * overall) / (n + prior)


def decayed_prior(alpha: Column, decay: float = 0.5) -> Column:
    return 1 + (alpha - 1) * decay


def greedy_propensity(action: Column, requested: Column, actions: int, epsilon: float) -> Column:
    """Exact propensity of an epsilon-greedy choice."""
    return F.lit(epsilon / actions) + F.when(action == requested, 1 - epsilon).otherwise(0.0)


def thompson_propensities(arms: DataFrame, draws: int = 800, seed: int = 7) -> DataFrame:
    """Share of seeded Beta draws that each arm of a key wins. A key's arms are a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arm")
        x = np.random.default_rng(seed).beta(pdf["alpha"].to_numpy(float), pdf["beta"].to_numpy(float), (draws, len(pdf)))
        wins = np.bincount(x.argmax(1), minlength=len(pdf)) / draws
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "arm": pdf["arm"].to_numpy(), "propensity": wins})

    return arms.groupBy("key").applyInPandas(run, "key string, arm string, propensity double")


def episode_reward(verified: Column, attempts: Column, budget: Column, aborted: Column) -> Column:
    return F.when(aborted, -1.0).when(~verified, 0.0).otherwise(1 - (attempts - 1) / F.greatest(budget, F.lit(1)))


def reward_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are there."""
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)
