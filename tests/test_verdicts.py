import itertools
import math

import pytest
from pyspark.sql import functions as F

from tracemill.operators import policy, verdicts


def test_signature_drift_names_breaking_changes_only(spark):
    schema = "symbol string, name string, place int, kind string, required boolean"
    before = spark.createDataFrame([("f", "a", 0, "pos", True), ("f", "b", 1, "pos", False), ("f", "c", 2, "pos", False), ("g", "x", 0, "pos", True), ("gone", "y", 0, "pos", True)], schema)
    after = spark.createDataFrame([("f", "b", 0, "pos", True), ("f", "a", 1, "key", True), ("f", "d", 2, "pos", True), ("f", "e", 3, "pos", False), ("g", "x", 0, "pos", True)], schema)
    got = {(r.symbol, r.change, r.name) for r in verdicts.signature_drift(before, after).collect()}
    assert got == {("f", "removed", "c"), ("f", "required", "b"), ("f", "kind", "a"), ("f", "new-required", "d"), ("f", "reordered", None)}
    assert verdicts.signature_drift(before, after.limit(0)).count() == 0


def test_reconciled(spark):
    rows = [("accept", None, "stand"), ("no_response", "reproduces", "unchanged"), ("reject_no_detail", "reproduces", "ask"), ("reject_with_detail", None, "ask"), ("reject_with_detail", "reproduces", "retract_and_redispatch"), ("reject_with_detail", "does_not_reproduce", "stand"), ("reject_with_detail", "unavailable", "stand")]
    df = spark.createDataFrame(rows, "reaction string, counterexample string, expected string")
    assert df.where(verdicts.reconciled(F.col("reaction"), F.col("counterexample")) != F.col("expected")).count() == 0


def test_resolution_differences(spark):
    rows = [("a", "same", "1", True), ("b", "same", "1", True), ("a", "moved", "1", True), ("b", "moved", "2", True), ("a", "one", "1", True), ("a", "unset", None, True), ("b", "unset", "1", True), ("c", "failed", "9", False)]
    df = spark.createDataFrame(rows, "mode string, package string, version string, ok boolean")
    assert {r.package: r.versions for r in verdicts.resolution_differences(df).collect()} == {"moved": ["1", "2"], "one": ["1"], "unset": ["1"]}
    assert verdicts.resolution_differences(df.where("mode = 'a'")).count() == 0  # one mode has nothing to differ from


def test_baseline_with_nulls_and_empty_tables(spark):
    schema = "probe_id string, status int, shape string, digest string, stable boolean"
    o = spark.createDataFrame([("a", 200, None, "d", True), ("b", None, None, None, None), ("c", 200, "s", "d", False)], schema)
    got = {r.probe_id: tuple(r)[1:] for r in verdicts.against_baseline(o, o.drop("stable").limit(0)).collect()}
    assert got == {"a": ("recorded", 200, None, "d"), "b": (None, None, None, None), "c": ("recorded", 200, "s", None)}
    entries = spark.createDataFrame([("a", 201, None, None), ("b", 200, "s", "d"), ("z", 500, "s", None)], "probe_id string, status int, shape string, digest string")
    got = {r.probe_id: tuple(r)[1:] for r in verdicts.against_baseline(o, entries).collect()}
    assert got == {"a": ("same", 201, None, "d"), "b": ("degraded", 200, "s", "d"), "c": ("recorded", 200, "s", None), "z": (None, 500, "s", None)}


def test_concurrency_needs_a_steady_serial_batch(spark):
    rows = [(t, p, 0, True, str(v), None, False) for t, p, values in [("lost", "serial", (1, 2)), ("lost", "concurrent", (1, 1)), ("clock", "serial", (1, 2)), ("clock", "serial-control", (1, 1)), ("clock", "concurrent", (1, 1)), ("alone", "concurrent", (1, 1))] for v in values]
    rows += [("late", "serial", 0, True, "1", None, False), ("late", "concurrent", 0, False, None, "Race", True)]
    df = spark.createDataFrame(rows, "target string, phase string, batch int, ok boolean, value string, exception string, timed_out boolean")
    got = {(r.target, r.kind, r.detail) for r in verdicts.concurrency_findings(verdicts.batch_profiles(df)).collect()}
    assert got == {("lost", "lost-update", "1/2"), ("late", "hang", "1/1")}


def test_promotion_needs_episodes_and_margin(spark):
    arms = lambda rows: spark.createDataFrame(rows, "arm int, n long, mean double")
    pick = lambda rows, **k: policy.preferred_arm(arms(rows), 0, 5, 0.1).first().arm
    assert pick([(0, 9, 0.5), (1, 1, 0.9)]) == 0
    assert pick([(0, 9, 0.5), (1, 5, 0.55)]) == 0
    assert pick([(0, 9, 0.5), (1, 5, 0.7), (2, 6, 0.7)]) == 1


def test_attempt_budget(spark):
    e = spark.createDataFrame([(True, True, a) for a in (1, 1, 2, 5)] + [(False, True, 9), (True, False, 9)], "objective boolean, verified boolean, attempts int")
    assert policy.attempt_budget(e, 0.5).first().budget == 2
    assert policy.attempt_budget(e, 0.9).first().budget == 6
    assert policy.attempt_budget(e, 0.9, 4).first().budget == 4
    assert policy.attempt_budget(e.limit(0)).first().budget is None


@pytest.mark.parametrize("features", [2, 3])
def test_shapley_equals_the_mean_over_orders(spark, features):
    value = {a: math.sin(a + 1.0) for a in range(1 << features)}
    want = [0.0] * features
    for order in itertools.permutations(range(features)):
        arm = 0
        for f in order:
            want[f] += (value[arm | 1 << f] - value[arm]) / math.factorial(features)
            arm |= 1 << f
    got = {r.feature: r.credit for r in policy.shapley_credit(spark.createDataFrame(list(value.items()), "arm int, value double"), features).collect()}
    assert all(abs(got[f] - want[f]) < 1e-9 for f in range(features))


def test_policy_of_no_evidence(spark):
    none = spark.createDataFrame([], "arm int, objective boolean, verified boolean")
    arms = policy.arm_posteriors(none)
    assert {(r.n, r.mean) for r in arms.collect()} == {(0, 0.5)}
    assert {(r.credit, r.evidence) for r in policy.counterfactual_credit(arms).collect()} == {(0.0, 0)}
    logged = spark.createDataFrame([], "decision_id string, action int, propensity double, reward double, epoch string")
    r = policy.support(logged, 1).first()
    assert (r.n, r.ess, r.clip, r.supported) == (0, 0.0, 1.0, False)
    assert policy.epoch_deltas(logged, 0, 1).count() == 0


def test_fault_verdicts(spark):
    rows = [
        ("chunk-convergence", "error", "ValueError", None, "fault-divergence"), ("chunk-convergence", "ok", None, True, None), ("import", "error", "ValueError", None, "import-error"), ("run", "error", "ValueError", None, None), ("run", "error", "KeyError", None, "fault-crash"),
        ("run", "error", None, None, "fault-crash"), ("chunk-sweep", "error", "ValueError", True, "fault-divergence"), ("chunk-sweep", "error", "ValueError", False, None), ("chunk-sweep", "error", "KeyError", None, "fault-crash"), (None, None, "KeyError", True, None), (None, "error", "TypeError", None, None), ("run", "error", "ValueError", True, None),
    ]
    df = spark.createDataFrame(rows, "phase string, status string, error_type string, divergent boolean, expected string")
    assert df.where(~verdicts.fault_verdict(*map(F.col, ("phase", "status", "error_type", "divergent"))).eqNullSafe(F.col("expected"))).count() == 0
