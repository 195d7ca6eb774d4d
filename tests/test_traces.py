import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.operators import ranges, traces

LOG = "session_id string, request_id string, thread_id string, seq long, event string, component string, depth int, parent_component string, ts_ms double, duration_ms double, errored boolean, io boolean, blocked_ms double"


def plain_spans(log):
    """Stacks per (request, thread, component, depth), then a search of the earlier spans one level up, newest first."""
    stacks, spans = defaultdict(list), []
    for s, q, t, seq, event, comp, depth, parent, ts, ms, err, io, blocked in sorted(log, key=lambda x: x[3]):
        if event == "enter":
            stacks[s, q, t, comp, depth].append((seq, parent, ts))
        elif stacks[s, q, t, comp, depth]:
            begun, parent, start = stacks[s, q, t, comp, depth].pop()
            spans.append({"key": (s, q), "seq": begun, "component": comp, "depth": depth, "parent": parent, "start": start, "ms": ms or 0.0, "errored": bool(err), "io": bool(io), "blocked": blocked or 0.0, "exit": seq})
    out, done = [], defaultdict(list)
    for x in sorted(spans, key=lambda x: (x["start"], x["depth"], x["exit"])):
        up = [p for p in done[x["key"], x["depth"] - 1] if p["component"] == x["parent"] and p["start"] + p["ms"] + 1.5 >= x["start"]] if x["depth"] > 0 else []
        x["up"] = up[-1]["seq"] if up else None
        done[x["key"], x["depth"]].append(x)
        out.append(x)
    return out


@pytest.fixture(scope="module")
def log():
    """Three requests on two threads, one of them with two thirds of all lines: spans in order of completion, overlapping, some exits lost."""
    rng, lines, seq = random.Random(4), [], 0
    for k in range(700):
        request, depth = rng.choice(["a", "hot", "hot", "hot", "b"]), rng.randrange(4)
        start, ms = rng.randrange(0, 4000) * 1.0, rng.choice([0.0, 1.0, 3.0, 40.0, 300.0, 2500.0])
        comp, parent = rng.choice(["m.f", "m.g", "h"]), rng.choice(["m.f", "m.g", "h"])
        base = ("s", request, rng.choice(["t1", "t2"]))
        lines.append((*base, seq, "enter", comp, depth, parent, start, None, None, None, None))
        if k % 11:
            lines.append((*base, seq + 1, "exit", comp, depth, parent, start + ms, ms, rng.random() < 0.1, rng.random() < 0.5, ms * rng.random()))
        if k % 50 == 0:
            lines.append((*base, seq + 2, "exit", "nobody", depth, parent, start, 5.0, False, False, 0.0))
        seq += 3
    return lines


def test_enclosing_spans_equal_a_plain_search(spark, log):
    df = spark.createDataFrame(random.Random(1).sample(log, len(log)), LOG)
    found = traces.enclosing_spans(traces.paired_spans(df))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(x["seq"], x["exit"], x["ms"], x["up"]) for x in plain_spans(log)}
    assert {(r.seq, r.exit_seq, r.duration_ms, r.parent_seq) for r in found.collect()} == want
    assert sum(x[3] is not None for x in want) > 200
    assert traces.enclosing_spans(traces.paired_spans(df.limit(0))).count() == 0


def test_children_are_found_across_threads_and_within_slack(spark):
    rows = [
        ("s", "r", "t1", 0, "enter", "root", 0, None, 100.0, None, None, None, None), ("s", "r", "t1", 1, "exit", "root", 0, None, None, 10.0, False, False, 0.0), ("s", "r", "t2", 2, "enter", "late", 1, "root", 111.4, None, None, None, None),
        ("s", "r", "t2", 3, "exit", "late", 1, "root", None, 1.0, False, False, 0.0), ("s", "r", "t2", 4, "enter", "gone", 1, "root", 111.6, None, None, None, None), ("s", "r", "t2", 5, "exit", "gone", 1, "root", None, 1.0, False, False, 0.0),
        (None, None, None, 6, "enter", "x", 1, "root", 101.0, None, None, None, None), (None, None, None, 7, "exit", "x", 1, "root", None, 1.0, None, None, None),
    ]
    got = {r.component: r.parent_seq for r in traces.enclosing_spans(traces.paired_spans(spark.createDataFrame(rows, LOG))).collect()}
    assert got == {"root": None, "late": 0, "gone": None, "x": None}


def test_spans_that_are_all_open_at_once_need_no_pairs(spark):
    rows = [("s", "r", i, "f" if i % 2 else "g", i % 2, "g", float(i), 1e6 - 2 * i if i % 6 else 3.0, False, False, 0.0, 2 * i) for i in range(4000)]
    spans = spark.createDataFrame(rows, "session_id string, request_id string, seq long, component string, depth int, parent_component string, start_ms double, duration_ms double, errored boolean, io boolean, blocked_ms double, exit_seq long").withColumn("thread_id", F.lit("t"))
    found = traces.enclosing_spans(spans)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # pairs of points with open spans grow with the square of the log, and a small file of many rows was broadcast
    # Before an odd start: the span just begun, be it a short one, which has not ended within the slack of 1.5 ms.
    assert {r.seq: r.parent_seq for r in found.collect()} == {i: i - 1 if i % 2 else None for i in range(4000)}
    plan = traces.span_signals(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2  # rows of spans meet callers by sorting


def test_line_order_closes_calls_that_lost_their_exits(spark):
    events = "enter a, enter b, enter c, exit a, enter d, exit z, enter e, exit e, exit d".split(", ")
    rows = [("s", "r", "t", i, *x.split(" "), i * 1.0, 7.0) for i, x in enumerate(events)] + [("s", "r", "u", 20, "exit", "a", 0.0, 1.0), ("s", "r", "u", 21, "enter", "a", 0.0, None)]
    df = spark.createDataFrame(rows, "session_id string, request_id string, thread_id string, seq long, event string, component string, ts_ms double, duration_ms double")
    tree = lambda how: {(r.thread_id, r.seq): (r.component, r.parent_seq, r.depth, r.exit_seq, r.duration_ms) for r in traces.line_order_spans(df, how).collect()}
    want = {("t", 0): ("a", None, 0, 3, 7.0), ("t", 1): ("b", 0, 1, None, None), ("t", 2): ("c", 1, 2, None, None), ("t", 4): ("d", None, 0, 8, 7.0), ("t", 6): ("e", 4, 1, 7, 7.0), ("u", 21): ("a", None, 0, None, None)}
    assert tree("keep") == want
    assert tree("clear") == want | {("t", 4): ("d", None, 0, None, None), ("t", 6): ("e", None, 0, 7, 7.0)}
    with pytest.raises(ValueError):
        traces.line_order_spans(df, "guess")


def plain_signals(spans):
    by, out = {(*x["key"], x["seq"]): x for x in spans}, defaultdict(lambda: defaultdict(float))
    inner = defaultdict(list)
    for x in spans:
        if x["up"] is not None:
            inner[*x["key"], x["up"]].append(x)
    for k, x in by.items():
        x["own"] = max(0.0, x["ms"] - sum(c["ms"] for c in inner[k]))
    usual = {c: [x["own"] for x in spans if x["component"] == c and not x["errored"] and x["ms"] > 0] for c in {x["component"] for x in spans}}
    for k, x in by.items():
        o = out[x["component"]]
        if not x["errored"]:
            o["self_ms"] += x["own"]
            o["wall_ms"] += x["ms"]
            o["blocked_ms"] += x["blocked"]
        for comp in {c["component"] for c in inner[k]}:
            ms = [c["ms"] for c in inner[k] if c["component"] == comp and not c["errored"]]
            if len(ms) >= 4 and sum(ms) > 0:
                out[comp]["n_plus_one_ms"] += sum(ms) * (len(ms) - 1) / len(ms)
                out[comp]["n_count"] = max(out[comp]["n_count"], len(ms))
        waits = sorted((c["start"], c["seq"], c["ms"]) for c in inner[k] if c["io"] and not c["errored"] and c["ms"] > 0 and c["start"] > 0)
        if len(waits) > 1 and all(b[0] >= a[0] + a[2] - 1 for a, b in zip(waits, waits[1:], strict=False)) and (saved := sum(w[2] for w in waits) - max(w[2] for w in waits)) > 0:
            o["serial_ms"] += saved
            o["serial_count"] = max(o["serial_count"], len(waits))
        dist = usual[x["component"]]
        if not x["errored"] and not x["io"] and x["ms"] > 0 and len(dist) >= 3:
            middle = statistics.median(dist)
            if x["own"] > middle + 1.4826 * statistics.median(abs(v - middle) for v in dist):
                o["wait_ms"] += x["own"] - middle
                o["wait_count"] += 1
    return out


def test_signals_equal_plain_sums(spark, log):
    more, seq = list(log), 10_000
    for request, children in (("serial", [(10.0, 30.0), (40.0, 20.0), (60.5, 5.0)]), ("overlap", [(10.0, 30.0), (30.0, 20.0)]), ("many", [(i * 10.0 + 1, 2.0) for i in range(6)])):
        for comp, depth, parent, start, ms, io in [("m.f", 0, None, 1.0, 200.0, False), *[("db.read", 1, "m.f", a, b, request != "many") for a, b in children]]:
            more += [("s", request, "t", seq, "enter", comp, depth, parent, start, None, None, None, None), ("s", request, "t", seq + 1, "exit", comp, depth, parent, None, ms, False, io, 0.0)]
            seq += 2
    want = plain_signals(plain_spans(more))
    got = {r.component: r.asDict() for r in traces.span_signals(traces.enclosing_spans(traces.paired_spans(spark.createDataFrame(more, LOG)))).collect()}
    assert got.keys() == want.keys() and got["db.read"]["n_parent"] == "f" and got["m.f"]["serial_ms"] >= 25.0
    for comp, o in want.items():
        for name in ("self_ms", "wall_ms", "blocked_ms", "n_plus_one_ms", "n_count", "serial_ms", "serial_count", "wait_ms", "wait_count"):
            assert got[comp][name] == pytest.approx(o[name]), (comp, name)


def test_candidates_by_largest_kind(spark):
    timings = spark.createDataFrame(
        [("loop", "s1", 1, 100, 50.0, 0.0, 0), ("loop", "s2", 2, 40, 80.0, 0.0, 0), ("caller", "s2", 2, 10, 10.0, 0.0, 0), ("cached", "s2", 2, 10, 20.0, 0.0, 0), ("waits", "s2", 2, 10, 10.0, 0.0, 0), ("slow", "s2", 2, 1, 90.0, 0.0, 0), ("alloc", "s3", 3, 10, 10.0, 50.0, 900), ("small", "s3", 3, 10, 10.0, 50.0, 100), ("idle", "s2", 2, 0, 0.0, 0.0, 0)],
        "component string, session_id string, at int, calls long, total_ms double, gc_pause_ms double, alloc_bytes long")
    signals = spark.createDataFrame([("waits", 0.0, 10.0, 9.0, 0.0, 0.0, 3.0), ("slow", 80.0, 90.0, 45.0, 0.0, 1.0, 0.0)], "component string, self_ms double, wall_ms double, blocked_ms double, n_plus_one_ms double, serial_ms double, wait_ms double")
    cache, calls = spark.createDataFrame([("cached", 19.0), ("caller", 500.0)], "component string, reclaimable_ms double"), spark.createDataFrame([("caller", "loop"), ("caller", "cached")], "src string, dst string")
    run = lambda **k: {r.component: r for r in traces.optimization_candidates(timings, signals, cache, calls, spark.createDataFrame([("fanout", 0.5)], "waste_kind string, ratio double"), **k).collect()}
    got = run(coverage=1.1)
    assert {c: r.waste_kind for c, r in got.items()} == {"loop": "fanout", "caller": "cache", "cached": "cache", "waits": "wait", "slow": "per-call", "alloc": "gc-pressure"}
    assert got["loop"].predicted_ms == 60.0 and got["loop"].effective_ms == 30.0 and got["caller"].predicted_ms == 10.0 and got["alloc"].predicted_ms == 10.0
    assert got["slow"].predicted_ms == pytest.approx(80 * (1 - 1.5 / 80) * 0.5) and [r.component for r in sorted(got.values(), key=lambda r: r.place)][:2] == ["slow", "loop"]
    assert len(run(cap=2)) == 2 and set(run(coverage=0.3)) == {"slow"}


def test_medians_of_groups(spark):
    data = [("hot", float(i * 37 % 1001)) for i in range(1001)] + [(None, 1.0), (None, 2.0), ("b", 5.0), ("c", None)]
    got = {r.g: (r.n, r.median) for r in ranges.medians(spark.createDataFrame(data, "g string, x double"), ["g"], "x").collect()}
    assert got == {"hot": (1001, 500.0), None: (2, 1.5), "b": (1, 5.0)}
