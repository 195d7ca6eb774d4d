"""Verdicts on what was observed: against a recorded baseline, a reference, a serial run, or a former signature.

Every verdict is a column expression over joined rows, so whole ledgers are judged in one pass. Nulls count as "not known": a null
status is no response, a null ``ok`` is a failure, a null digest or shape expresses no opinion of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import status_class
from ..functions.text import normal_repr


def class_rank(status: Column) -> Column:
    """How good a status is: 0 no response, 1 server error, 2 rejection, 3 healthy."""
    return F.when(status.isNull(), 0).when(status >= 500, 1).when(status >= 400, 2).otherwise(3)


def against_baseline(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each probe's verdict and the entry that the run leaves behind.

    ``observed``: probe_id (one row each), status, shape, digest, stable. ``baseline``: probe_id, status, shape, digest. A probe without an
    entry is ``recorded`` if healthy, and has no verdict otherwise. One with an entry is ``degraded`` or ``improved`` by the class of its
    status; a healthy one of the same class is ``degraded`` if its shape differs, or else its digest where both have one; else ``same``.
    The entry left (entry_status, entry_shape, entry_digest, null if none): a recorded or improved observation replaces it, its digest kept
    only if stable; a stable digest fills a missing one of a probe that stayed the same. Probes that were not observed keep their entry.
    """
    o = observed.select("probe_id", *[F.col(c).alias(f"_{c}") for c in ("status", "shape", "digest", "stable")], F.lit(True).alias("_seen"))
    b = baseline.select("probe_id", "status", "shape", "digest", F.lit(True).alias("_known"))
    both = o.join(b, "probe_id", "full")
    seen, known = F.col("_seen").isNotNull(), F.col("_known").isNotNull()
    now, before = class_rank(F.col("_status")), class_rank(F.col("status"))
    differs = ~F.col("_shape").eqNullSafe(F.col("shape")) | F.coalesce(F.col("_digest") != F.col("digest"), F.lit(False))
    verdict = (
        F.when(~seen, None).when(~known, F.when(now == 3, "recorded")).when(now < before, "degraded").when(now > before, "improved")
        .when((before == 3) & differs, "degraded").otherwise("same")
    )
    judged = both.withColumn("verdict", verdict)
    replaced = F.coalesce(F.col("verdict").isin("recorded", "improved"), F.lit(False))
    stable = F.when(F.col("_stable"), F.col("_digest"))
    digest = F.when(replaced, stable).when(F.col("verdict") == "same", F.coalesce("digest", stable)).otherwise(F.col("digest"))
    return judged.select("probe_id", "verdict", F.when(replaced, F.col("_status")).otherwise(F.col("status")).alias("entry_status"), F.when(replaced, F.col("_shape")).otherwise(F.col("shape")).alias("entry_shape"), digest.alias("entry_digest"))


def replay_difference(expected_status: Column, status: Column, expected_shape: Column, shape: Column, before_ms: Column, ms: Column, factor: float = 2.0) -> Column:
    """``behavior`` (another class of status), ``contract`` (healthy, another shape), ``perf`` (over the factor of more than 1 ms), or null."""
    was, now = status_class(expected_status), status_class(status)
    return F.when(was != now, "behavior").when((was == "ok") & ~expected_shape.eqNullSafe(shape), "contract").when((before_ms > 1) & (ms > before_ms * factor), "perf")


def reference_verdict(rows: DataFrame) -> Column:
    """Of a comparison (ref_ok, ref_value, ref_exception, got_ok, got_value, got_exception, got_message, adjudication): its kind, or null if both agree.

    Values are compared without addresses. A target that fails agrees if it names the reference's exception anywhere. A refusal is what its
    stored adjudication says (``policy`` or ``defect``), and ``unadjudicated`` without one.
    """
    c = {n: rows[n] for n in ("ref_value", "ref_exception", "got_value", "got_exception", "got_message", "adjudication")}
    ref_ok, got_ok = (F.coalesce(rows[n], F.lit(False)) for n in ("ref_ok", "got_ok"))
    text = lambda n: F.coalesce(c[n], F.lit(""))
    refusal = lambda defect: F.when(c["adjudication"] == "policy", "policy-limit").when(c["adjudication"] == "defect", defect).otherwise("unadjudicated")
    named = (text("ref_exception") == "") | F.contains(F.concat_ws(" ", text("got_exception"), text("got_message")), text("ref_exception"))
    return (
        F.when(ref_ok & got_ok, F.when(normal_repr(text("ref_value")) != normal_repr(text("got_value")), "wrong-value"))
        .when(ref_ok, refusal("rejects-valid")).when(got_ok, "accepts-invalid").when(~named, refusal("wrong-exception"))
    )


def implausible_targets(rows: DataFrame, least: int = 20, share: float = 0.9) -> DataFrame:
    """Targets of at least so many comparisons that differ in so large a share of those where both sides gave a value: (target, answered, differing)."""
    both = F.coalesce(F.col("ref_ok") & F.col("got_ok"), F.lit(False))
    g = rows.groupBy("target").agg(F.count("*").alias("_n"), F.count_if(both).alias("answered"), F.count_if(both & ~F.col("ref_value").eqNullSafe(F.col("got_value"))).alias("differing"))
    return g.where((F.col("_n") >= least) & (F.col("answered") > 0) & (F.col("differing") >= share * F.col("answered"))).drop("_n")


def batch_profiles(results: DataFrame, key: str = "target") -> DataFrame:
    """(key, phase, batch, calls, late, ok, distinct, failures) of (key, phase, batch, ok, value, exception, timed_out): what may be compared between two schedules."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return results.groupBy(key, "phase", "batch").agg(F.count("*").alias("calls"), F.count_if("timed_out").alias("late"), F.count_if(ok).alias("ok"), F.count_distinct(F.when(ok, F.coalesce("value", F.lit("None")))).alias("distinct"), F.array_sort(F.collect_set(F.when(~ok, F.coalesce("exception", F.lit("None"))))).alias("failures"))


def concurrency_findings(profiles: DataFrame, key: str = "target") -> DataFrame:
    """Distinct (key, kind, detail) of concurrent batches against the key's serial one.

    ``hang``: calls that did not return in time, and nothing else of that batch; ``lost-update``: fewer distinct values than serially, unless a second serial batch (phase ``serial-control``) shows that the number
    varies by itself; ``new-exceptions``: raised by no serial call. Keys without a serial batch have no finding.
    """
    p = profiles.groupBy(key).agg(
        F.min(F.when(F.col("phase") == "serial", F.col("distinct"))).alias("serial"), F.min(F.when(F.col("phase") == "serial-control", F.col("distinct"))).alias("control"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("phase") == "serial", F.col("failures"))))).alias("usual")).where("serial is not null")
    rows = profiles.where(F.col("phase") == "concurrent").join(p, key)
    lost = (F.col("ok") > 0) & (F.col("distinct") < F.col("serial")) & F.coalesce(F.col("control") == F.col("serial"), F.lit(True))
    new = F.array_except("failures", "usual")
    in_time = F.col("late") == 0
    found = F.array_compact(F.array(
        F.when(~in_time, F.struct(F.lit("hang").alias("kind"), F.concat_ws("/", F.col("late").cast("string"), F.col("calls").cast("string")).alias("detail"))),
        F.when(in_time & lost, F.struct(F.lit("lost-update").alias("kind"), F.concat_ws("/", F.col("distinct").cast("string"), F.col("serial").cast("string")).alias("detail"))),
        F.when(in_time & (F.size(new) > 0), F.struct(F.lit("new-exceptions").alias("kind"), F.array_join(new, ",").alias("detail")))))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.kind", "f.detail").distinct()


def signature_drift(before: DataFrame, after: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Breaking changes (symbol, change, name) between parameters (symbol, name, place, kind, required): ``removed``, ``required`` (was optional),
    ``kind``, ``new-required``, and one ``reordered`` (null name) for a symbol whose common parameters stand in another order. Only symbols
    on both sides are compared; a new optional parameter breaks nothing.
    """
    a = before.select(symbol, "name", *[F.col(c).alias(f"_{c}") for c in ("place", "kind", "required")])
    b = after.select(symbol, "name", "place", "kind", "required")
    shared = a.select(symbol).distinct().join(b.select(symbol).distinct(), symbol)
    both = a.join(b, [symbol, "name"], "full").join(shared, symbol)
    gone, new = F.col("place").isNull(), F.col("_place").isNull()
    changes = F.array_compact(F.array(
        F.when(gone, "removed"), F.when(new & F.col("required"), "new-required"), F.when(~gone & ~new & F.col("required") & ~F.col("_required"), "required"), F.when(~gone & ~new & (F.col("kind") != F.col("_kind")), "kind")))
    single = both.select(symbol, F.explode(changes).alias("change"), "name")
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "name"))), lambda x: x["name"])  # noqa: E731  one symbol's parameters
    moved = both.where(~gone & ~new).groupBy(symbol).agg(order("_place").alias("a"), order("place").alias("b")).where("a <> b")
    return single.union(moved.select(symbol, F.lit("reordered"), F.lit(None).cast("string")))


def reconciled(reaction: Column, counterexample: Column) -> Column:
    """What a reaction to a verified result leads to: ``stand``, ``unchanged``, ``ask`` or ``retract_and_redispatch``; it is retracted only on a case that reproduces."""
    detail = F.when(counterexample.isNull(), "ask").when(counterexample == "reproduces", "retract_and_redispatch").otherwise("stand")
    return F.when(reaction == "accept", "stand").when(reaction == "no_response", "unchanged").when(reaction == "reject_no_detail", "ask").otherwise(detail)


def resolution_differences(resolved: DataFrame) -> DataFrame:
    """Packages (package, versions) whose version differs, or is missing, in any of two or more modes; ``resolved``: mode, package, version, ok."""
    ok = resolved.where("ok")
    modes = ok.agg(F.count_distinct("mode").alias("modes"))
    g = ok.where("package is not null").groupBy("package").agg(F.count_distinct("mode").alias("n"), F.array_sort(F.collect_set("version")).alias("versions"), F.count_if(F.col("version").isNull()).alias("missing"))
    return g.join(F.broadcast(modes), (F.col("modes") >= 2) & ((F.col("n") < F.col("modes")) | (F.size("versions") > 1) | (F.col("missing") > 0))).select("package", "versions")  # the broadcast side is one row


# Exceptions by which a consumer refuses what it was given.
TYPED_REJECTIONS = ("TypeError", "ValueError", "NotImplementedError", "ValidationError", "PydanticCustomError")


def fault_verdict(phase: Column, status: Column, error_type: Column, divergent: Column) -> Column:
    """What is wrong with the outcome of a fault; null: nothing. A refusal by type is no failure, but it is one where only some ways to cut the same input are refused (``divergent``)."""
    failed = status.eqNullSafe(F.lit("error"))
    swept = phase.eqNullSafe(F.lit("chunk-sweep")) & F.coalesce(divergent, F.lit(False))
    refused = F.coalesce(error_type.isin(*TYPED_REJECTIONS), F.lit(False))
    return F.when(~failed, None).when(phase.eqNullSafe(F.lit("chunk-convergence")), "fault-divergence").when(phase.eqNullSafe(F.lit("import")), "import-error").when(swept, "fault-divergence").when(~refused, "fault-crash")
