from tracemill.functions import percentiles
from tracemill.operators import lifecycle, ranges


def test_numbered_over_ranges(spark):
    data = [(g, k * 7 % 1000, k) for g, n in (("hot", 1000), (None, 40), ("b", 3)) for k in range(n)]
    df = spark.createDataFrame(data, "g string, at int, x long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranges.numbered(df, ["g"], ["at"], "n", {"upto": "x"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = set()
    for g in ("hot", None, "b"):
        total = 0
        for n, (_, at, x) in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1]), 1):
            total += x
            want.add((g, at, x, n, total))
    assert {tuple(r) for r in got} == want and len(got) == len(data)


def test_order_statistics_of_groups_with_equal_values(spark):
    data = [("hot", i * 7 % 50) for i in range(1000)] + [("one", 5), ("two", 1), ("two", 2), (None, 1), ("gone", None)]
    df = spark.createDataFrame(data, "g string, x int")
    picks = {"low": percentiles.floor_index_at(0.3), "clamped": percentiles.clamped_index_at(0.5), "near": percentiles.nearest_rank_at(0.9), "last": lambda n: n - 1}
    got = {r.g: tuple(r)[1:] for r in ranges.order_statistics(df, ["g"], "x", picks).collect()}
    want = {}
    for g in ("hot", "one", "two"):
        v = sorted(x for k, x in data if k == g)
        n = len(v)
        want[g] = (n, v[int(0.3 * (n - 1))], v[min(int(n * 0.5), n - 1)], v[max(-(-9 * n // 10) - 1, 0)], v[-1])
    assert got == want


def test_keys_missing_from_sessions(spark):
    sessions = [(f"s{i}", i // 2 * 10.0) for i in range(20)]
    attempts = [(f"k{i}", float(i)) for i in range(0, 95, 5)]
    sightings = [(f"k{i}", f"s{i * 3 % 20}") for i in range(0, 95, 5)] + [("k10", "s19"), ("k10", "s19"), ("k10", "nowhere")]
    frames = spark.createDataFrame(sessions, "session_id string, at double"), spark.createDataFrame(attempts, "key string, last_activity double"), spark.createDataFrame(sightings, "key string, session_id string")
    want = {k: n for k, t in attempts if (n := sum(at > t and (k, s) not in set(sightings) for s, at in sessions)) >= 3}
    assert {r.key: r.missed for r in lifecycle.expired_keys(*frames).collect()} == want


def test_invariants_hold_no_field_in_one_task(spark):
    """rising ids are told by ranges of the rows, with what lies between two of them."""
    from tracemill.operators.statistics import learned_invariants

    rows = [(e, f, i, str(i), float(i if e != "falls" or i != 500 else 3)) for e in ("rises", "falls", None) for f in ("id", "size") for i in range(1000)] + [("rises", "none_id", i, None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "endpoint string, field string, seq long, text string, number double").repartition(7)
    found = learned_invariants(df)
    assert "rangepartitioning(endpoint" in found._jdf.queryExecution().toString()
    got = {(r.endpoint, r.field, r.kind): (r.n, r.kinds, r.low, r.high) for r in found.collect()}
    assert {k[:2] for k in got if k[2] == "id_monotonic"} == {("rises", "id"), (None, "id")}
    assert got["rises", "id", "numeric_bound"] == (1000, 1000, 0.0, 999.0) and len(got) == 14
