import hashlib
import random
from math import erf, exp, factorial, sqrt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import intervals

PRIME = 2**31 - 1


def test_normal_quantile_and_distribution(spark):
    p = [1e-9, 0.001, 0.024, 0.025, 0.3, 0.5, 0.97, 0.976, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(intervals.normal_quantile(F.col("p")).alias("z"), intervals.normal_cdf(intervals.normal_quantile(F.col("p"))).alias("back")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=2e-9, abs=1e-9)
    assert [r.back for r in got] == pytest.approx(p, rel=1e-6)
    x = [-9.0, -6.5, -2.0, -0.1, 0.0, 1.0, 3.0, 6.9, 8.0]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(intervals.normal_cdf(F.col("x"))).collect()] == pytest.approx([0.5 * (1 + erf(v / sqrt(2))) for v in x], abs=1e-12)
    assert spark.createDataFrame([(0.0,), (1.0,)], "p double").select(intervals.normal_quantile(F.col("p")).alias("z")).where("z is not null").count() == 0


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(9)
    return [(f"d{i}", a, {0: 0.5, 1: 0.3, 2: 0.2}[a], rng.random() + 0.2 * a) for i in range(60) for a in [rng.choices([0, 1, 2], [5, 3, 2])[0]]]


def draw_weights(ids, draws, seed):
    h = np.array([int(hashlib.md5(i.encode()).hexdigest()[:8], 16) % PRIME for i in ids], dtype=object)
    steps = np.cumsum([exp(-1) / factorial(k) for k in range(13)])
    for b in range(draws):
        n = int(hashlib.md5(f"{seed}|{b}".encode()).hexdigest()[:15], 16)
        u = np.array([((x * (1 + n % (PRIME - 1)) + n // PRIME % PRIME) % PRIME) / PRIME for x in h])
        yield (u[:, None] >= steps[None, :]).sum(1)


def plain_delta(samples, fold, w, base, target):
    a, p, y = (np.array(x) for x in zip(*[s[1:] for s in samples], strict=True))

    def value(action):
        total = 0.0
        for f in (0, 1):
            mine, other = (fold == f), (fold != f)
            m = other & (a == action)
            q = (w[m] @ y[m]) / w[m].sum() if w[m].sum() else (w[other] @ y[other]) / w[other].sum() if w[other].sum() else 0.0
            total += (w[mine] * (q + np.where(a[mine] == action, (y[mine] - q) / p[mine], 0.0))).sum()
        return total / w.sum()

    return value(target) - value(base), value(target)


def test_interval_equals_numpy(spark, samples):
    fold = np.zeros(len(samples), int)
    for action in (0, 1, 2):
        ids = sorted((i for i, s in enumerate(samples) if s[1] == action), key=lambda i: hashlib.sha256(samples[i][0].encode()).hexdigest())
        fold[ids] = np.arange(len(ids)) % 2
    df = spark.createDataFrame(samples, "decision_id string, action int, propensity double, reward double")
    drawn = [plain_delta(samples, fold, w, 0, 1) for w in draw_weights([s[0] for s in samples], 150, 3)]
    point, dr = plain_delta(samples, fold, np.ones(len(samples)), 0, 1)
    got = {r.draw: r for r in intervals.bootstrap_values(df, 0, 1, 150, 3).collect()}
    assert len(got) == 151 and [got[b].delta for b in range(150)] == pytest.approx([x for x, _ in drawn]) and got[-1].dr == pytest.approx(dr)
    values = sorted(x for x, _ in drawn)
    below = sum(x < point - 1e-12 for x in values)
    z0 = NormalDist().inv_cdf(min(max(below / 150, 1 / 151), 150 / 151))
    jack = np.array([plain_delta(samples[:i] + samples[i + 1 :], np.delete(fold, i), np.ones(len(samples) - 1), 0, 1)[0] for i in range(len(samples))])
    off = jack.mean() - jack
    accel = (off**3).sum() / (6 * (off**2).sum() ** 1.5)

    def end(level):
        z = z0 + NormalDist().inv_cdf(level)
        share = NormalDist().cdf(z0 + z / (1 - accel * z)) if 1 - accel * z > 0 else level
        return values[min(149, max(0, int(share * 149)))]

    r = intervals.bootstrap_delta(df, 0, 1, 150, 3).first()
    assert (r.n, r.below) == (60, below) and (r.delta, r.z0, r.accel) == pytest.approx((point, z0, accel), abs=1e-8)
    assert (r.low, r.high, r.plain_low, r.plain_high) == pytest.approx((end(0.025), end(0.975), values[int(0.025 * 149)], values[int(0.975 * 149)]))
    assert intervals.bootstrap_delta(df.limit(0), 0, 1, 20).count() == 0
    assert intervals.bootstrap_delta(df.limit(1), 0, 1, 20).count() == 1


def test_draws_resemble_resampling(spark):
    df = spark.range(2000).selectExpr("concat('q', id) AS question", "(id % 10) - 4.0 AS gain")
    r = intervals.bootstrap_mean(df, "question", "gain", 400, 1).first()
    assert r.mean == pytest.approx(0.5) and (r.win_rate, r.loss_rate) == (0.5, 0.4)
    assert r.high - r.low == pytest.approx(2 * 1.96 * 2.8723 / sqrt(2000), rel=0.2) and r.low < 0.5 < r.high
    w = intervals.with_draws(df, "question", 50).where("draw >= 0").groupBy().agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q")).first()
    assert w.s / 100_000 == pytest.approx(1.0, abs=0.03) and w.q / 100_000 == pytest.approx(2.0, abs=0.1)


def test_sums_of_draws_are_made_without_a_row_for_each_draw(spark):
    df = spark.createDataFrame([(f"d{i}" if i else None, float(i % 7), float("inf") if i == 4 else 1.0) for i in range(300)], "k string, x double, y double")
    got = intervals.draw_sums(df, "k", ["x", "y"], 20, 5)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    want = intervals.with_draws(df, "k", 20, 5).groupBy("draw").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in "xy"])
    want = {r.draw: (r.x, r.y) for r in want.collect()}
    assert {r.draw: (r.x, r.y) for r in got.collect()} == want and any(y < float("inf") for _, y in want.values())
    rows = spark.createDataFrame([("a", 0, 0.5, 1.0), ("b", 1, 0.5, 2.0)], "decision_id string, action int, propensity double, reward double")
    assert "Generate" not in intervals.bootstrap_values(rows, 0, 1, 10)._jdf.queryExecution().executedPlan().toString()
