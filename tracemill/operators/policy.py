"""Learned policies of arms and retrieval depths: posteriors, credit of features, calibration, and the gates before a change."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised
from .intervals import halves
from .statistics import shrunk_mean


def arm_posteriors(episodes: DataFrame, arms: int = 8, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(arm, n, alpha, beta, mean) of all arms from episodes (arm, objective, verified): only objective ones count, arms without any keep the prior."""
    seen = episodes.where(F.col("objective") & F.col("arm").between(0, arms - 1)).groupBy(F.col("arm").cast("int").alias("arm")).agg(F.count("*").alias("n"), F.count_if("verified").alias("won"))
    every = episodes.sparkSession.range(arms).select(F.col("id").cast("int").alias("arm"))
    rows = every.join(seen, "arm", "left").fillna(0, ["n", "won"]).select("arm", "n", (alpha + F.col("won")).alias("alpha"), (beta + F.col("n") - F.col("won")).alias("beta"))
    return rows.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def counterfactual_credit(posteriors: DataFrame, features: int = 3, prior: float = 2.0) -> DataFrame:
    """(feature, credit, evidence): arms are sets of features as bits. An arm with the feature is set against the arm that lacks only it,
    weighted by the episodes of both; pairs with an arm never tried don't count, and the mean shrinks to 0 by ``prior`` episodes.
    """
    bits = posteriors.sparkSession.range(features).select(F.col("id").cast("int").alias("feature"))
    rich = posteriors.select(F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("feature"), "arm", "n", "mean")
    rich = rich.where(F.expr("(arm & shiftleft(1, feature)) <> 0")).withColumn("base", F.expr("arm - shiftleft(1, feature)"))
    pairs = rich.join(posteriors.select(F.col("arm").alias("base"), F.col("n").alias("m"), F.col("mean").alias("without")), "base").where("n > 0 and m > 0")
    weight = F.col("n") + F.col("m")
    g = pairs.groupBy("feature").agg(F.sum(weight * (F.col("mean") - F.col("without"))).alias("gain"), F.sum(weight).alias("evidence"))
    return bits.join(g, "feature", "left").select("feature", F.coalesce(F.col("gain") / (F.col("evidence") + prior), F.lit(0.0)).alias("credit"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def shapley_credit(values: DataFrame, features: int = 3) -> DataFrame:
    """(feature, credit): exact Shapley values of (arm, value) over all sets of features, arms being sets as bits."""
    rich = values.select(F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("feature"), "arm", "value").where(F.expr("(arm & shiftleft(1, feature)) <> 0"))
    pairs = rich.withColumn("base", F.expr("arm - shiftleft(1, feature)")).join(values.select(F.col("arm").alias("base"), F.col("value").alias("without")), "base")
    others = F.bit_count("base")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(features - k - 1) / math.factorial(features)) for k in range(features)]), others + 1)
    return pairs.groupBy("feature").agg(F.sum(weight * (F.col("value") - F.col("without"))).alias("credit"))


def preferred_arm(posteriors: DataFrame, incumbent: int, least: int, margin: float) -> DataFrame:
    """One row (arm): the arm of the highest mean, the lowest of equals, if it has the episodes and beats the incumbent by the margin; else the incumbent."""
    best = posteriors.agg(F.max_by(F.struct("arm", "n", "mean"), F.struct("mean", -F.col("arm"))).alias("best"), F.max(F.when(F.col("arm") == incumbent, F.col("mean"))).alias("now"))
    wins = (F.col("best.n") >= least) & (F.col("best.mean") - F.col("now") >= margin)
    return best.select(F.when(wins, F.col("best.arm")).otherwise(F.lit(incumbent)).cast("int").alias("arm"))


def attempt_budget(episodes: DataFrame, quantile: float = 0.9, most: int = 10) -> DataFrame:
    """One row (budget): the quantile of attempts of objective, verified episodes (nearest rank), and one more; null if there are none."""
    won = episodes.where(F.col("objective") & F.col("verified"))
    need = F.expr(f"percentile_disc({quantile}) within group (order by attempts)")
    return won.agg(F.when(F.count("attempts") > 0, F.least(F.lit(most), F.greatest(F.lit(1), F.round(need)) + 1)).cast("int").alias("budget"))


def calibration(outcomes: DataFrame, prior: float = 3.0) -> DataFrame:
    """(waste_kind, n, ratio, shrunk): measured over predicted time of proven and regressed outcomes with a positive prediction, shrunk to the overall ratio."""
    ok = F.col("verdict").isin("proven", "regressed") & (F.col("predicted_ms") > 0) & F.col("delta_ms").isNotNull()
    sums = outcomes.where(ok).groupBy("waste_kind").agg(F.count("*").alias("n"), F.sum(F.abs("delta_ms") / F.col("predicted_ms")).alias("_sum"))
    whole = Window.partitionBy()  # one row for each kind of waste
    overall = F.sum("_sum").over(whole) / F.sum("n").over(whole)
    ratio = F.col("_sum") / F.col("n")
    return sums.select("waste_kind", "n", ratio.alias("ratio"), shrunk_mean(ratio, F.col("n"), overall, prior).alias("shrunk"))


def support(samples: DataFrame, target: int, clip: float | None = None, least_ess: float = 25.0, least: int = 40, pulls: int = 8) -> DataFrame:
    """One row: how well logged (action, propensity) cover always taking ``target``: n, matched, overlap, ess, clip, clipped (share), supported.

    Without a clip the largest weight of a matched sample is the clip, so nothing is cut.
    """
    raw = F.when(F.col("action") == target, 1 / F.col("propensity"))
    weight = F.coalesce(F.least(raw, F.lit(float(clip))) if clip else raw, F.lit(0.0))
    g = samples.agg(F.count("*").alias("n"), F.count(raw).alias("matched"), F.sum(weight).alias("_s"), F.sum(weight * weight).alias("_q"), F.coalesce(F.lit(float(clip)) if clip else F.max(raw), F.lit(1.0)).alias("clip"), F.count_if(raw > clip if clip else F.lit(False)).alias("_cut"))
    ess = F.when(F.col("_q") > 0, F.col("_s") * F.col("_s") / F.col("_q")).otherwise(F.lit(0.0))
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    ok = (ess >= least_ess) & (F.col("n") >= least) & (F.col("matched") >= pulls)
    return g.select("n", "matched", share("matched").alias("overlap"), ess.alias("ess"), "clip", share("_cut").alias("clipped"), ok.alias("supported"))


def epoch_deltas(samples: DataFrame, baseline: int, target: int, least: int = 20, tolerance: float = 0.1) -> DataFrame:
    """(epoch, n, delta, ok): doubly robust gain of ``target`` over ``baseline`` within each epoch of enough samples (decision_id, action, propensity, reward, epoch).

    Action means are fitted on two halves of each action's samples of the epoch, dealt in turn by a hash of the decision, and used for
    the other half; a half without an action falls back on the half's mean.
    """
    s = materialised(halves(samples, ["epoch", "action"]).withColumn("fit", 1 - F.col("fold")), "folds")
    per = s.groupBy("epoch", "fold", "action").agg(F.sum("reward").alias("total"), F.count("reward").alias("n"))
    half = per.groupBy(F.col("epoch").alias("_epoch"), F.col("fold").alias("fit")).agg(  # each half's means, for the other one
        (F.sum("total") / F.sum("n")).alias("overall"), *[(F.sum(F.when(F.col("action") == a, F.col("total"))) / F.sum(F.when(F.col("action") == a, F.col("n")))).alias(f"_{name}") for name, a in (("b", baseline), ("t", target))])
    rows = s.join(half, (s["epoch"].eqNullSafe(half["_epoch"])) & (s["fit"] == half["fit"]), "left").fillna(0.0, ["overall"])

    def value(name: str, action: int) -> Column:
        q = F.coalesce(f"_{name}", "overall")
        return q + F.when(F.col("action") == action, (F.col("reward") - q) / F.col("propensity")).otherwise(0.0)

    g = rows.groupBy("epoch").agg(F.count("*").alias("n"), F.avg(value("t", target) - value("b", baseline)).alias("delta"))
    return g.where(F.col("n") >= least).withColumn("ok", F.col("delta") >= -tolerance)


def exploration_floor(epsilon: Column, decayed: Column, sparse_share: Column, k: float = 1.0) -> Column:
    """Never above the first epsilon, and above the decayed one while many features are sparsely tried."""
    return F.least(epsilon, F.greatest(decayed, k * sparse_share * epsilon))
