import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracemill.functions import percentiles, predicates, text
from tracemill.operators import aggregates, graph, lifecycle, retrieval, statistics
from tracemill.sources.spans import read_trace
from tracemill.sources.tables import materialised
from tracemill.streaming.rollup import stream_rollup, stream_spans


@pytest.fixture(scope="module")
def calls(spark):
    rows = [("s", 3, "2024-01-01 00:00:00.002", "r1", "svc.repo.fetch", "svc.handler", 1, 1.0, "ok"), ("s", 4, "2024-01-01 00:00:00.003", "r1", "svc.handler", None, 0, 3.0, "ok"), ("s", 6, "2024-01-01 00:01:00.005", "r2", "svc.handler", None, 0, 5.0, "error")]
    return spark.createDataFrame(rows, "session_id string, seq long, ts string, request_id string, component string, parent_component string, depth int, duration_ms double, status string").withColumn("ts", F.to_timestamp("ts"))


def test_mini_log(calls):
    s = {r.component: r for r in aggregates.symbol_stats(calls).collect()}["svc.handler"]
    assert (s.calls, s.total_ms, s.errors, s.error_rate, s.p50, s.p95, s.p99) == (2, 8.0, 1, 0.5, 4.0, 3.0, 3.0)
    assert [tuple(r) for r in aggregates.dependency_edges(calls, 1).collect()] == [("svc.handler", "svc.repo.fetch", 1)]
    assert aggregates.dependency_edges(calls).count() == 0
    top = aggregates.suspects(calls).collect()
    assert (top[0].component, round(top[0].score, 4)) == ("svc.handler", 0.7071) and top[1].score == 0
    assert aggregates.rollup(calls).count() == 3
    assert {r.request_id: (r.entry_component, r.status, r.duration_ms) for r in aggregates.request_rows(calls).collect()} == {"r1": ("svc.handler", "ok", 3.0), "r2": ("svc.handler", "error", 5.0)}


def test_percentiles_differ(spark):
    df, x = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 10)], "x double"), F.col("x")
    r = df.agg(percentiles.interpolated(x, 0.9), percentiles.floor_index(x, 0.9), percentiles.clamped_index(x, 0.9), percentiles.nearest_rank(x, 0.9), percentiles.mad(x)).first()
    assert [round(v, 4) for v in r] == [7.9, 3.0, 10.0, 10.0, round(1.4826, 4)]


def test_tokens_and_text(spark):
    r = spark.sql("select 'HTTPServer42 find_byId é1' as t, 'a/b/c.py' as p, 'a/b/d.py' as q, 'pkg/__init__.py' as i")
    out = r.select(text.tokens(F.col("t")), text.shared_prefix(F.col("p"), F.col("q")), text.module_of(F.col("i")), text.joined_route(F.lit("/api/"), F.lit("/x/")), text.redacted(F.lit("token=abc http://u:p@h")), text.chunk_cases(F.lit("abc"))).first()
    assert out[0] == ["http", "server", "42", "find", "by", "id", "é", "1"]
    assert list(out)[1:5] == [2, "pkg", "/api/x", "token=*** http://***@h"]
    assert out[5] == [["a", "bc"], ["ab", "c"], ["a", "b", "c"]]


def test_three_valued_containment(spark):
    df = spark.sql("select * from values (array(true, null)), (array(false, false)), (array(cast(null as boolean))) as t(v)")
    assert [r[0] for r in df.select(predicates.containment(F.col("v"))).collect()] == [True, False, None]


@pytest.mark.parametrize("seed", range(2))
def test_incremental_index_equals_rebuild(spark, seed):
    rng, words = np.random.default_rng(seed), "alpha beta gamma delta eps zeta eta theta iota kappa lamda mu".split()
    old = {i: " ".join(rng.choice(words, 6)) for i in range(12)}
    new = {i: t for i, t in old.items() if i % 4} | {i: " ".join(rng.choice(words, 5)) for i in (1, 20)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    changed, removed = {i: t for i, t in new.items() if old.get(i) != t}, spark.createDataFrame([(i,) for i in old if i not in new], "doc_id long")
    got = retrieval.updated_postings(retrieval.postings(frame(old))[0], frame(changed), removed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.postings(frame(new))[0].collect()))


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxy"], "id string")
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, e, iterations=4).collect()}
    ids, m, v = list("abcdxy"), np.zeros((6, 6)), np.full(6, 1 / 6)
    for s, t in e.collect():
        m[ids.index(t), ids.index(s)] = 1
    deg = m.sum(0)
    for _ in range(4):
        v = 0.15 / 6 + 0.85 * (m @ np.where(deg > 0, v / np.maximum(deg, 1), 0) + v[deg == 0].sum() / 6)
    assert np.allclose([got[i] for i in ids], v / v.max())
    assert {(r.direction, r.id, r.depth) for r in graph.blast_radius(e, "a").collect()} >= {("down", "b", 1), ("down", "d", 3), ("up", "c", 1)}
    assert {r.id for r in graph.dead_code(nodes, e, spark.createDataFrame([("a",)], "seed string")).collect()} == {"x", "y"}


def test_pagerank_without_cycles_takes_as_many_rounds_as_the_longest_path(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialised", lambda df, label: written.append(label) or materialised(df, label))
    links = [("o1", "p"), ("o2", "p"), ("o2", "q"), ("p", "s"), ("q", "out"), ("out", "p")]  # "out" is no node
    ids = ["o1", "o2", "p", "q", "s", "alone"]
    got = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links, "src string, dst string")).collect()}
    degree, rank = Counter(a for a, _ in links), dict.fromkeys(ids, 1 / 6)
    for _ in range(40):
        lost = sum(x for i, x in rank.items() if not degree[i])
        rank = {i: 0.15 / 6 + 0.85 * (sum(rank[a] / degree[a] for a, b in links if b == i and a in rank) + lost / 6) for i in ids}
    assert got == pytest.approx({i: x / max(rank.values()) for i, x in rank.items()}, abs=1e-12)
    assert len(written) < 10  # one for each step before: 42


def test_statistics(spark):
    bh = statistics.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "component string, p double"))
    assert {r.component: round(r.q, 6) for r in bh.collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}
    n = np.array([1, 2, 4, 8, 16, 32], float)
    pts = spark.createDataFrame([("k", float(c), float(100 * c / (1 + 0.05 * (c - 1) + 0.001 * c * (c - 1)))) for c in n], "key string, concurrency double, req_per_s double")
    u = statistics.usl_fit(pts).first()
    assert abs(u.sigma - 0.05) < 2e-3 and abs(u.kappa - 0.001) < 2e-4 and u.r2 > 0.999
    b = statistics.bootstrap_improvement(spark.createDataFrame([("k", 10.0 + i % 3, 6.0) for i in range(20)], "key string, before double, after double")).first()
    assert b.verdict == "proven" and b.low <= b.improvement <= b.high
    assert statistics.ks_two_sample(np.arange(50.0), np.arange(50.0) + 100)[0] == 1.0


def test_lifecycle(spark):
    rows = spark.createDataFrame([("k", i, 10.0 - i) for i in range(6)], "unit string, id long, v double")
    head = lifecycle.pareto_head(rows, "v", "id", 0.5, 8)
    assert [r.id for r in head.orderBy("id").collect()] == [0, 1, 2]
    assert lifecycle.selection_record(rows, head, "v", 0.5, 8, "t").first().stopped_by == "coverage"


def test_span_reader_and_stream(spark, tmp_path):
    line = lambda **x: json.dumps({"ts": "2024-01-01T00:00:00Z", "request_id": "r", "component": "c", "level": "info", "depth": 0, "thread_id": 1, "parent_component": None} | x)
    (tmp_path / "trace.jsonl").write_text("\n".join([line(event="enter"), line(event="exit", duration_ms=2.0, status="error"), '{"torn', json.dumps({"event": "gc_pause", "duration_ms": 1.0}), line(event="what")]) + "\n")
    t = read_trace(spark, str(tmp_path))
    t.lines.cache()
    assert (t.enters.count(), t.exits.count(), t.gc.count(), t.skipped.first()[0]) == (1, 1, 1, 2)
    q = stream_rollup(stream_spans(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("roll").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.component, r.calls, r.error_count) for r in spark.table("roll").collect()] == [("c", 1, 1)]


def test_entry_runs_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_call_forest_pairs_last_in_first_out(spark):
    import random

    from tracemill.operators import spans

    rng, rows, want = random.Random(4), [], []
    for request in "abcd":
        for thread in (1, 2):
            stack = []
            for seq in range(60):
                event = rng.choice(["enter", "enter", "exit", "gc"])
                rows.append((request, thread, seq, seq, f"c{seq % 4}", event))
                if event == "enter":
                    stack.append([request, thread, seq, None, stack[-1][2] if stack else None])
                    want.append(stack[-1])
                elif event == "exit" and stack:
                    stack.pop()[3] = seq
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "request_id string, thread_id int, seq long, ts long, component string, event string").withColumn("ts", F.timestamp_seconds("ts"))
    got = spans.call_forest(log)
    assert sorted((r.request_id, r.thread_id, r.seq, r.exit_seq, r.parent_seq) for r in got.collect()) == sorted(map(tuple, want))
    assert all(r.self_ms <= r.total_ms for r in spans.self_times(got).collect())
    assert spans.call_forest(log.limit(0)).count() == 0


def test_redaction_covers_schemes_and_quoted_keys(spark):
    from tracemill.functions import text

    cases = {
        "Authorization: Bearer sk-123456": "Authorization: ***", "{'openai_api_key': 'sk-abc'}": "{'openai_api_key': ***}", "bearer abc.def ok": "bearer *** ok", "password=hunter2&x=1": "password=***&x=1",
        "https://u:p@h/x": "https://***@h/x", "a token is fine": "a token is fine", "Authorization: Basic dXNlcjpw, next": "Authorization: ***, next",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.redacted(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == cases


def test_usl_fit_finds_the_law_and_refuses_flat_sweeps(spark):
    from tracemill.operators import statistics

    n = [1, 2, 4, 8, 16, 32]
    rows = [("good", k, 100 * k / (1 + 0.05 * (k - 1) + 0.4 * k * (k - 1))) for k in n] + [("flat", k, 50.0) for k in n] + [("few", k, 10.0 * k) for k in (1, 2)] + [("good", 0, 5.0), ("good", 4, 0.0)]
    got = {r.key: r for r in statistics.usl_fit(spark.createDataFrame(rows, "key string, concurrency int, req_per_s double")).collect()}
    assert abs(got["good"].sigma - 0.05) < 1e-3 and abs(got["good"].kappa - 0.4) < 1e-3 and got["good"].r2 > 0.999
    assert got["flat"].sigma is None and got["few"].rate is None


def test_test_paths(spark):
    from tracemill.functions import predicates

    yes = ["tests/a.py", "x\\Test\\a", "a/__tests__/b.js", "test_a.py", "a/b_test.go", "a.spec.ts", "b/c.test.js"]
    no = ["spec/a.rs", "fixtures/a", "conftest.py", "a/contest.py", "latest/a.py", "a/testing.py"]
    got = spark.createDataFrame([(x,) for x in yes + no], "p string").select("p", predicates.is_test_path(F.col("p")).alias("t")).collect()
    assert {r.p for r in got if r.t} == set(yes)


def test_porcelain_records_are_read_in_order(spark):
    from tracemill.sources import spans

    status = "R  new name.txt\0my file.txt\0 M a b.py\0?? c\0"
    got = spans.porcelain_changes(spark.createDataFrame([(status,)], "status string")).collect()
    assert {r.file for r in got} == {"new name.txt", "my file.txt", "a b.py", "c"}


def test_lines_keep_their_order_in_long_files(spark, tmp_path):
    import json

    from tracemill.sources import spans

    (tmp_path / "t.jsonl").write_text("".join(json.dumps({"type": "x", "ts": i}) + "\n" for i in range(120_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        lines = spans.read_lines(spark, str(tmp_path), "type string, ts double")
        assert lines.rdd.getNumPartitions() > 4
        ts = [r.ts for r in lines.orderBy("file", "seq").select("ts").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ts == sorted(ts) and len(ts) == 120_000


def test_benjamini_hochberg_over_ranges(spark):
    from tracemill.operators import statistics

    p = [((i * 7919) % 1009 + 1) / 1010 for i in range(500)]
    got = {r.component: r.q for r in statistics.benjamini_hochberg(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "component long, p double")).collect()}
    order = sorted(range(500), key=lambda i: (p[i], i))
    least = 1.0
    for rank in range(500, 0, -1):
        least = min(least, p[order[rank - 1]] * 500 / rank)
        assert abs(got[order[rank - 1]] - least) < 1e-12
