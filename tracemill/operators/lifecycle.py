"""Ordered and lifecycle operators: latest sessions, heads by coverage, newest rows, ledgers.

Global cumulative shares first aggregate to one row a key, and are taken over that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.percentiles import MAD_SCALE, median_of
from .ranges import numbered


def latest_session(rows: DataFrame, key: list[str], epoch: str = "epoch", at: str = "captured_ts") -> DataFrame:
    """Rows of each key's newest session; sessions of one epoch and time are one, whatever their paths."""
    order = Window.partitionBy(*key).orderBy(F.coalesce(F.col(epoch), F.lit(-1)).desc(), F.col(at).desc_nulls_last())
    return rows.withColumn("_rank", F.rank().over(order)).where("_rank = 1").drop("_rank")


def supersession(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Is what a symbol's last session showed still so? code_changed, not_reproduced, or null."""
    newest = sessions.groupBy("component").agg(F.max("epoch").alias("seen"), F.max(F.when(F.col("errors") > 0, F.col("epoch"))).alias("failed"))
    out = newest.join(chunks.select("component", F.col("epoch").alias("changed")), "component", "left")
    verdict = F.when(F.col("failed").isNull(), F.lit(None).cast("string")).when(F.col("changed") > F.col("failed"), "code_changed").when(F.col("seen") > F.col("failed"), "not_reproduced")
    return out.select("component", verdict.alias("superseded_by"))


def pareto_head(rows: DataFrame, value: str, tie: str, coverage: float = 0.8, cap: int = 8) -> DataFrame:
    """The largest rows until they cover a share of the total or their number is reached; ``rows`` has one row a key."""
    order = [F.desc(value), F.col(tie)]
    total = rows.agg(F.sum(value).alias("_total"))
    top = rows.orderBy(*order).limit(cap)  # a top-k, so the cumulative sum below sees `cap` rows only
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = top.join(F.broadcast(total)).withColumn("covered_before", F.coalesce(F.sum(value).over(before), F.lit(0.0))).where(F.col("covered_before") < coverage * F.col("_total"))
    return out.withColumn("share", F.col(value) / F.col("_total")).drop("_total")


def selection_record(rows: DataFrame, chosen: DataFrame, value: str, coverage: float, cap: int, stage: str) -> DataFrame:
    """What a selection returned and dropped, what it covers, and what stopped it."""
    a = rows.agg(F.count("*").alias("total"), F.sum(value).alias("magnitude"))
    b = chosen.agg(F.count("*").alias("returned"), F.coalesce(F.sum(value), F.lit(0.0)).alias("got"))
    share = F.when(F.col("magnitude") > 0, F.col("got") / F.col("magnitude")).otherwise(F.lit(1.0))
    stopped = F.when(F.col("returned") == F.col("total"), "exhausted").when(share >= coverage, "coverage").otherwise("cap")
    return a.join(b).select(F.lit(stage).alias("stage"), "returned", "total", (F.col("total") - F.col("returned")).alias("dropped"), share.alias("coverage_achieved"), (F.col("magnitude") - F.col("got")).alias("residual"), stopped.alias("stopped_by"))


def chain_status(records: DataFrame) -> DataFrame:
    """A cap anywhere dominates, then coverage."""
    seen = F.collect_set("stopped_by")
    return records.agg(F.when(F.array_contains(seen, "cap"), "cap").when(F.array_contains(seen, "coverage"), "coverage").otherwise("exhausted").alias("stopped_by"))


def newest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key: last write wins, later lines win ties."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def first_divergence(golden: DataFrame, current: DataFrame) -> DataFrame:
    """Per request the first position at which two runs' results differ, with the component there."""
    at = Window.partitionBy("request_id").orderBy("seq")
    a, b = (df.select("request_id", F.row_number().over(at).alias("position"), F.col("component").alias(f"{n}_component"), F.col("result_hash").alias(f"{n}_hash")) for n, df in (("golden", golden), ("current", current)))
    differ = a.join(b, ["request_id", "position"]).where(~F.col("golden_hash").eqNullSafe(F.col("current_hash")))
    return differ.groupBy("request_id").agg(F.min("position").alias("position"), F.min_by("golden_component", "position").alias("component"))


def monotone_breaks(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows whose value is not above the last one that was there."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(value, ignorenulls=True).over(w)).where(F.col(value) <= F.col("previous"))


def decayed_history(rows: DataFrame, key: list[str], order: str, identity: Column, decay: float = 0.5) -> DataFrame:
    """The newest row of each key, and its k-th older one if a hash of it, read as a uniform number, is below decay ** k."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    uniform = F.conv(F.substring(F.sha2(identity, 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return rows.withColumn("age", F.row_number().over(w) - 1).where((F.col("age") == 0) | (uniform < F.pow(F.lit(decay), "age")))


def evicted_board(entries: DataFrame, unit: str, value: str, tie: str, per_unit: int = 2, cap: int = 24) -> DataFrame:
    """The best entries of each unit, and of these the best overall."""
    rank = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(value), tie))
    return entries.withColumn("_rank", rank).where(F.col("_rank") <= per_unit).drop("_rank").orderBy(F.desc(value), tie).limit(cap)


def completed_episodes(events: DataFrame) -> DataFrame:
    """Starts with their first end; episodes that were retracted are out."""
    start = events.where("type = 'episode_start'").groupBy("episode_id").agg(F.min_by(F.struct("arm", "propensity", "ts"), "seq").alias("s"))
    end = events.where("type = 'episode_end'").groupBy("episode_id").agg(F.min_by(F.struct("reward", "attempts", "verified", F.col("ts").alias("ended")), "seq").alias("e"))
    gone = events.where("type = 'retraction'").select("episode_id").distinct()
    return start.join(end, "episode_id").join(gone, "episode_id", "left_anti").select("episode_id", "s.*", "e.*")


def expired_keys(sessions: DataFrame, attempts: DataFrame, sightings: DataFrame, least: int = 3) -> DataFrame:
    """Keys that were in none of at least so many sessions after their last activity.

    ``sessions``: session_id, at, one row each. ``attempts``: key, last_activity, one row each. ``sightings``: key, session_id. The sessions up to a time are numbered over sorted ranges of both tables' times, and those after it that saw the key are taken off.
    """
    both = sessions.select(F.col("at"), F.lit(0).alias("_kind"), F.lit(None).cast(attempts.schema["key"].dataType).alias("key"), F.lit(1).alias("_one"))
    both = both.unionByName(attempts.select(F.col("last_activity").alias("at"), F.lit(1).alias("_kind"), "key", F.lit(0).alias("_one"))).where("at is not null").withColumn("_g", F.lit(0))
    upto = numbered(both, ["_g"], ["at", "_kind"], "_place", {"_before": "_one"}, "session-times").where("_kind = 1").select("key", "_before")
    total = sessions.where("at is not null").agg(F.count("*").alias("_all"))
    seen = sightings.select("key", "session_id").distinct().join(sessions, "session_id").join(attempts, "key").where(F.col("at") > F.col("last_activity")).groupBy("key").agg(F.count("*").alias("_seen"))
    missed = upto.join(F.broadcast(total)).join(seen, "key", "left").select("key", (F.col("_all") - F.col("_before") - F.coalesce("_seen", F.lit(0))).alias("missed"))
    return missed.where(F.col("missed") >= least)


def active_since(events: DataFrame, since: float) -> DataFrame:
    """Episodes with an end or an outcome at or after a second before ``since``."""
    return events.where(F.col("type").isin("episode_end", "outcome") & (F.col("ts") >= since - 1)).select("episode_id").distinct()


def noise_band(values: Column, relative_spread: Column | None = None) -> Column:
    """Scaled median deviation of a baseline, floored by a relative spread; a tenth of a single value."""
    centre = median_of(values)
    band = MAD_SCALE * median_of(F.transform(values, lambda v: F.abs(v - centre)))
    floor = F.abs(centre) * (relative_spread if relative_spread is not None else F.lit(0.0))
    return F.when(F.size(values) <= 1, 0.1 * F.abs(centre)).otherwise(F.greatest(band, floor))


def reconciled(after: Column, before: Column, band: Column, behaviour_ok: Column, changed: Column) -> Column:
    """A measured outcome against its noise band."""
    return F.when(~changed, "dismissed").when(~behaviour_ok, "regressed").when(after < before - band, "proven").when(after > before + band, "regressed").otherwise("inconclusive")


def carried_epochs(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """Unchanged chunks keep their epoch; all others get the one after the last."""
    last = previous.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("_last"))
    old = previous.select("id", "sha", F.col("epoch").alias("_old"))
    return chunks.drop("epoch").join(old, ["id", "sha"], "left").join(F.broadcast(last)).withColumn("epoch", F.coalesce("_old", F.col("_last") + 1)).drop("_old", "_last")


def table_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or same, by key."""
    b, a = before.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), after.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    kind = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, kind.alias("change"))
