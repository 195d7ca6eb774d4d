import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from tracemill.operators import drift

DAYS = "bucket timestamp, component string, latency_p95 double, error_rate double, qps double, notes string"


def test_report_on_four_buckets(spark):
    at = [datetime(2020, 1, d) for d in (1, 2, 3, 4)]
    rows = [(t, "a", p, e, 1.0, "x") for t, p, e in zip(at, (1.0, 2.0, 10.0, 20.0), (0.0, 0.1, 0.0, 0.2), strict=True)]
    df = spark.createDataFrame(rows, DAYS)
    got = {r.metric: r for r in drift.drift_report(df, "1970-01-01,2020-01-02", "2020-01-03,2099-01-01").collect()}
    assert set(got) == {"latency_p95", "error_rate", "qps"}
    p = got["latency_p95"]
    eps, half = 1e-12, 0.5  # two bins of the baseline; nothing of the window falls into them
    assert (p.n_baseline, p.n_window) == (2, 2) and p.wasserstein == pytest.approx(13.5)
    assert p.psi == pytest.approx(2 * -half * math.log(eps / (half + eps))) and p.entropy_divergence == pytest.approx(2 * half * math.log(half / half))
    q = got["qps"]
    assert (q.psi, q.kl_histogram, q.wasserstein) == pytest.approx((0.0, 0.0, 0.0), abs=1e-9)


def test_report_equals_numpy_with_gaps_and_odd_values(spark):
    rng = np.random.default_rng(3)
    base, window = rng.normal(10, 3, 57).round(1), rng.normal(12, 4, 80).round(1)
    rows = [(datetime(2020, 1, 1) + timedelta(minutes=i), "c", float(v), None, float("nan"), "") for i, v in enumerate(base)] + [(datetime(2020, 2, 1) + timedelta(minutes=i), "c", float(v), 1.0, float("inf"), "") for i, v in enumerate(window)]
    got = {r.metric: r for r in drift.drift_report(spark.createDataFrame(rows, DAYS), "2020-01-01,2020-01-31", "2020-02-01,2020-03-01").collect()}
    assert set(got) == {"latency_p95", "error_rate"} and got["error_rate"].psi is None and got["error_rate"].n_window == 80
    r = got["latency_p95"]
    cuts = np.histogram(base, bins=10)[1]
    p, q = (np.histogram(x, bins=cuts)[0] / np.histogram(x, bins=cuts)[0].sum() for x in (base, window))
    assert r.psi == pytest.approx(float(((q - p) * np.log((q + 1e-12) / (p + 1e-12))).sum()))
    pe, qe = (p + 1e-12) / (p + 1e-12).sum(), (q + 1e-12) / (q + 1e-12).sum()
    assert r.entropy_divergence == pytest.approx(float((pe * np.log(pe / qe)).sum()))
    both = np.concatenate([base, window])
    edges = np.linspace(both.min(), both.max(), min(12, max(3, int(np.sqrt(57)) + 2)))
    p, q = (np.histogram(x, bins=edges, density=True)[0] + 1e-12 for x in (base, window))
    p, q = p / p.sum(), q / q.sum()
    assert r.kl_histogram == pytest.approx(float((p * np.log(p / q)).sum()))
    points = np.unique(both)
    gaps = np.abs(np.searchsorted(np.sort(base), points, "right") / 57 - np.searchsorted(np.sort(window), points, "right") / 80)
    assert r.wasserstein == pytest.approx(float((gaps[:-1] * np.diff(points)).sum()))
    assert drift.drift_report(spark.createDataFrame(rows, DAYS).select("bucket", "notes"), "2020-01-01,2020-01-31", "2020-02-01,2020-03-01").count() == 0


def test_exact_p_values_count_all_orders():
    for n, m in ((1, 1), (3, 4), (5, 5), (2, 7)):
        seen = {}
        for places in itertools.combinations(range(n + m), n):
            a = np.array(places, float)
            b = np.array([i for i in range(n + m) if i not in places], float)
            seen[places] = drift.exact_ks(a, b)
        all_d = [d for d, _ in seen.values()]
        for d, p in seen.values():
            assert p == pytest.approx(sum(x >= d - 1e-12 for x in all_d) / len(all_d))
    apart = drift.exact_ks(np.arange(40.0), np.arange(100.0, 160.0))
    assert apart == (1.0, pytest.approx(2 / math.comb(100, 40), rel=1e-12))
    big = drift.exact_ks(np.arange(3000.0), np.arange(3000.0) + 60)
    assert big[0] == pytest.approx(0.02) and 0.3 < big[1] < 0.8
    assert drift.exact_ks(np.array([]), np.array([1.0])) == (0.0, 1.0)


def test_root_causes_flags_the_shifted_component(spark):
    def rows(start, count, parent, child, other):
        for i in range(count):
            t = datetime(2020, start, 1) + timedelta(hours=i)
            yield from ((t, "parent.node", float(parent(i))), (t, "child.node", float(child(i))), (t, "calm.node", float(other(i))))

    data = [*rows(1, 60, lambda i: 10 + i % 3, lambda i: 20 + i % 2, lambda i: 30 + 2 * (i % 3)), *rows(2, 60, lambda i: 11 + i % 3, lambda i: 80 + i, lambda i: 32 + 2 * (i % 3)), (datetime(2020, 1, 1), "rare", 1.0), (datetime(2020, 2, 1), "rare", 1.0), (datetime(2020, 1, 2), "child.node", None)]
    metrics = spark.createDataFrame(data, "bucket timestamp, component string, value double")
    edges = spark.createDataFrame([("parent.node", "child.node"), ("parent.node", "calm.node"), ("gone", "child.node"), ("child.node", "rare"), ("parent.node", "child.node")], "src string, dst string")
    got = {r.component: r for r in drift.root_causes(metrics, edges, "2020-01-01,2020-01-31 23:59:59", "2020-02-01,2020-02-29 23:59:59").collect()}
    assert set(got) == {"child.node", "calm.node"}
    child, calm = got["child.node"], got["calm.node"]
    assert child.p < 0.05 and child.p_adjusted <= 0.05 and child.significant and child.ks == 1.0 and (child.n_fit, child.n_normal, child.n_incident) == (40, 20, 60) and child.parents == ["parent.node"]
    assert abs(calm["shift"]) < 1e-9 and child["shift"] > 50
    assert drift.root_causes(metrics.limit(0), edges, "2020-01-01,2020-01-31", "2020-02-01,2020-02-29").count() == 0
