import random
from collections import defaultdict
from math import ceil, log, log1p

import pytest

from tracemill.operators import clusters, graph, walks

BETA = {"invoke": 0.5, "inherit": 0.2, "contains": 0.1, "flow": 0.4}


def plain_walk(nodes, edges, flow, anchors, beta, alpha, tolerance, budget, hops=None):
    names = [n for _, n in nodes]
    ids = {i for i, _ in nodes}
    adj = {k: defaultdict(lambda: defaultdict(float)) for k in walks.KINDS}
    for s, d, kind, w in [(s, d, k, 1.0) for s, d, k in edges if k in walks.KINDS[:3]] + [(s, d, "flow", log1p(c)) for s, d, c in flow]:
        if s != d and s in ids and d in ids:
            adj[kind][s][d] += w
            adj[kind][d][s] += w
    s = defaultdict(float)
    for i, w in anchors:
        if i in ids:
            s[i] += w / names.count(dict(nodes)[i])
    total = sum(s.values())
    s = {i: x / total for i, x in s.items()}
    whole = sum(beta.values())
    pi = dict(s)
    for _ in range(max(1, ceil(log(tolerance) / log(1 - alpha))) if whole else 0):
        got, lost = defaultdict(float), 0.0
        for u, mass in pi.items():
            out = 0.0
            for k in walks.KINDS:
                degree = sum(adj[k][u].values())
                if degree > 0:
                    share = beta.get(k, 0.0) / whole
                    out += share
                    for v, w in adj[k][u].items():
                        got[v] += mass * share * w / degree
            lost += mass * (1 - out)
        pi = {i: alpha * s.get(i, 0.0) + (1 - alpha) * (got[i] + lost * s.get(i, 0.0)) for i in set(got) | set(s)}
    inside = set(s)
    if hops is not None:
        front = set(s)
        for _ in range(hops):
            front = {v for u in front for k in walks.KINDS for v in adj[k][u]} - inside
            inside |= front
    first = sorted(s, key=lambda i: (-pi[i], i))
    rest = sorted((i for i, x in pi.items() if x > 0 and i not in s and (hops is None or i in inside)), key=lambda i: (-pi[i], i))
    return [(i, pi[i]) for i in first + rest[: max(0, budget - len(first))]]


@pytest.fixture(scope="module")
def code():
    rng = random.Random(8)
    nodes = [(i, f"n{i % 30}") for i in range(80)]
    edges = [(rng.randrange(82), rng.choice([0, rng.randrange(80)]), rng.choice(["invoke", "inherit", "contains", "other"])) for _ in range(260)]  # node 0 is a hub
    flow = [(rng.randrange(80), rng.randrange(80), rng.randrange(20)) for _ in range(60)]
    return nodes, edges, flow


@pytest.mark.parametrize("hops", [None, 1])
def test_walk_equals_a_plain_one(spark, code, hops, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK", 16)
    nodes, edges, flow = code
    anchors = [(3, 1.0), (10, 0.5), (3, 0.25), (99, 5.0)]
    frames = spark.createDataFrame(nodes, "id long, name string"), spark.createDataFrame(edges, "src long, dst long, kind string"), spark.createDataFrame(flow, "src long, dst long, calls long"), spark.createDataFrame(anchors, "id long, weight double")
    got = walks.context_walk(*frames, beta=BETA, alpha=0.4, tolerance=0.05, budget=25, max_hops=hops).orderBy("place").collect()
    want = plain_walk(nodes, edges, flow, anchors, BETA, 0.4, 0.05, 25, hops)
    assert [r.id for r in got] == [i for i, _ in want] and [r.mass for r in got] == pytest.approx([x for _, x in want])
    assert [r.id for r in got if r.anchor] == [i for i, _ in want[:2]]


def test_walk_without_kinds_anchors_or_edges(spark, code):
    nodes = spark.createDataFrame(code[0], "id long, name string")
    edges = spark.createDataFrame(code[1], "src long, dst long, kind string")
    one = spark.createDataFrame([(5, 1.0)], "id long, weight double")
    assert [tuple(r) for r in walks.context_walk(nodes, edges, None, one, beta={}).collect()] == [(5, 1.0, True, 1)]
    assert walks.context_walk(nodes, edges, None, one.limit(0), beta=BETA).count() == 0
    alone = walks.context_walk(nodes, edges.limit(0), None, one, beta=BETA, alpha=0.5, tolerance=0.2).collect()
    assert [r.id for r in alone] == [5] and alone[0].mass == pytest.approx(1.0)


def test_walk_deals_neighbours_to_tasks_once(spark, monkeypatch):
    """F8: a step brings the masses to the neighbours, which no step shuffles."""
    monkeypatch.setattr(walks, "LEAST_PART", 1)
    plans, write = [], walks.materialised
    monkeypatch.setattr(walks, "materialised", lambda df, label, by=None: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), write(df, label, by))[1])
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id long, name string")
    edges = spark.createDataFrame([(0, 1, "invoke"), (0, 1, "invoke"), (1, 2, "inherit"), (9, 1, "invoke"), (2, 9, "invoke")], "src long, dst long, kind string")
    one = spark.createDataFrame([(0, 1.0)], "id long, weight double")
    got = walks.context_walk(nodes, edges, None, one, beta=BETA, alpha=0.5, tolerance=0.25).collect()
    want = plain_walk([(i, f"n{i}") for i in range(6)], [(0, 1, "invoke"), (0, 1, "invoke"), (1, 2, "inherit")], [], [(0, 1.0)], BETA, 0.5, 0.25, 40)
    assert [r.id for r in got] == [i for i, _ in want] and [r.mass for r in got] == pytest.approx([x for _, x in want])
    steps = [p for label, p in plans if label == "walk-mass"][1:]
    assert steps
    for plan in steps:
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if "InMemoryTableScan" in x)
        join = max(i for i in range(scan) if "Join" in lines[i])
        assert not any("Exchange" in x for x in lines[join:scan])


def plain_tree(edges, root, most):
    calls = defaultdict(set)
    for s, d in edges:
        calls[s].add(d)
    seen, out = {root}, {((root,), 0, root, "expanded" if root in calls else "leaf")}
    front = [(root,)] if root in calls else []
    for depth in range(1, most + 2):
        made = [(p, d) for p in sorted(front) for d in calls[p[-1]]]
        first, front = {}, []
        for p, d in made:
            if d is not None and d not in seen:
                first[d] = min(first.get(d, p), p)
        for p, d in made:
            if d is None:
                out.add((p, depth, None, "external"))
            elif d in seen or (depth <= most and first[d] != p):
                out.add((*((p + (d,),)), depth, d, "elsewhere"))
            elif depth > most:
                out.add((p + (d,), depth, d, "truncated"))
            elif d in calls:
                out.add((p + (d,), depth, d, "expanded"))
                front.append(p + (d,))
            else:
                out.add((p + (d,), depth, d, "leaf"))
        seen |= set(first)
        if depth > most or not front:
            break
    return out


def test_call_trees_with_cycles(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(25), rng.choice([None, *range(40)])) for _ in range(70)] + [(0, 1), (1, 2), (2, 0), (3, 3)]
    df, roots = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (3,), (39,), (0,)], "root long")
    for most in (2, 12):
        got = {(r.root, tuple(r.path), r.depth, r.id, r.state) for r in walks.call_trees(df, roots, most).collect()}
        assert got == {(root, *x) for root in (0, 3, 39) for x in plain_tree(edges, root, most)}
    tree = walks.call_trees(df, roots)
    paths = {(r.root, r.id): tuple(r.path) for r in walks.path_to(tree, spark.createDataFrame([(2,), (7,), (77,)], "id long")).collect()}
    want = defaultdict(list)
    for root in (0, 3, 39):
        for path, _, node, _ in plain_tree(edges, root, 12):
            if node in (2, 7):
                want[root, node].append((len(path), path))
    assert paths == {k: min(v)[1] for k, v in want.items()}


def plain_linkage(labels, sims):
    """One merge after the other: the nearest two clusters, of equal ones those with the lesser least members."""
    labels = sorted(set(labels))
    at = {x: i for i, x in enumerate(labels)}
    pair = {(min(at[a], at[b]), max(at[a], at[b])): round(s * clusters.UNIT) for a, b, s in sims if a != b}
    parts, number, out = {i: [i] for i in range(len(labels))}, {i: i for i in range(len(labels))}, []
    while len(parts) > 1:
        def mean(a, b):
            return sum(pair.get((min(x, y), max(x, y)), 0) for x in parts[a] for y in parts[b]) / (len(parts[a]) * len(parts[b]))
        best = max(((mean(a, b), -a, -b) for a in parts for b in parts if a < b))
        a, b = -best[1], -best[2]
        out.append((frozenset(parts[a]) | frozenset(parts[b]), round(1 - best[0] / clusters.UNIT, 9)))
        parts[a] += parts.pop(b)
    return out


def merged_sets(n, rows):
    made = {i: frozenset([i]) for i in range(n)}
    for r in sorted(rows, key=lambda r: r.step):
        made[n + r.step] = made[r.a] | made[r.b]
        assert r.a < r.b and len(made[n + r.step]) == r["size"]
        yield made[n + r.step], round(r.distance, 9)


@pytest.mark.parametrize("seed", [1, 2])
def test_dendrogram_equals_one_by_one_merging(spark, seed):
    rng = random.Random(seed)
    labels = [f"c{i:02}" for i in range(24)]
    values = [0.25, 0.5, 0.5, 1.0] if seed == 1 else [rng.random() for _ in range(50)]
    sims = [(a, b, rng.choice(values)) for i, a in enumerate(labels) for b in labels[i + 1 :] if rng.random() < 0.3]
    got = clusters.average_linkage(spark.createDataFrame([(x,) for x in labels], "name string"), spark.createDataFrame(sims, "component string, other string, jaccard double")).collect()
    assert [r.step for r in sorted(got, key=lambda r: r.step)] == list(range(23))
    heights = [r.distance for r in sorted(got, key=lambda r: r.step)]
    assert heights == sorted(heights)
    found, want = list(merged_sets(24, got)), plain_linkage(labels, sims)
    assert {x for x in found if x[1] < 1} == {x for x in want if x[1] < 1} and sorted(h for _, h in found) == sorted(h for _, h in want)


def test_dendrogram_takes_no_round_of_joins_for_each_level(spark, monkeypatch):
    """two chains, each of whose merges waits for the one before."""
    sims = [(f"{c}{i:02}", f"{c}{i + 1:02}", 0.9 / 1.5**i) for c in "ab" for i in range(11)]
    labels = spark.createDataFrame([(f"{c}{i:02}",) for c in "abz" for i in range(12 if c < "z" else 2)], "name string")
    df = spark.createDataFrame(sims, "component string, other string, jaccard double")
    written, write = [], clusters.materialised
    monkeypatch.setattr(clusters, "materialised", lambda df, label, *a: (written.append(label), write(df, label, *a))[1])
    got = sorted(map(tuple, clusters.average_linkage(labels, df).collect()))
    assert written.count("cluster-merges") == 1 and len(got) == 25
    monkeypatch.setattr(clusters, "LOCAL_PAIRS", 9)  # the first rounds by joins, what is left in a task
    assert sorted(map(tuple, clusters.average_linkage(labels, df).collect())) == got and written.count("cluster-merges") > 2


def test_dendrogram_of_requests_and_of_nothing(spark):
    pairs = [(r, c) for r, cs in enumerate(["abc", "ab", "ab", "cd", "e", "abcd"]) for c in cs]
    df = spark.createDataFrame(pairs, "request_id long, component string")
    got = clusters.average_linkage(df.select(df.component.alias("name")), graph.cooccurrence(df)).collect()
    rows = {r.step: (r.a, r.b, round(r.distance, 6), r["size"]) for r in got}
    assert rows[0] == (0, 1, 0.0, 2) and rows[1][:2] == (2, 3) and rows[3][2:] == (1.0, 5)
    none = spark.createDataFrame([], "component string, other string, jaccard double")
    assert clusters.average_linkage(spark.createDataFrame([("x",)], "name string"), none).count() == 0
    assert [(r.step, r.a, r.b, r["size"]) for r in clusters.average_linkage(spark.createDataFrame([("x",), ("y",), ("z",)], "name string"), none).orderBy("step").collect()] == [(0, 0, 1, 2), (1, 2, 3, 3)]


@pytest.mark.parametrize("few", [1_000, 0])
def test_dendrogram_of_a_large_part_rewrites_no_pairs(spark, monkeypatch, few):
    """a part too large for one task keeps a row for each cluster; pairs are written once, and joined again only where labels are too many to broadcast."""
    rng = random.Random(few)
    lines = [(rng.randrange(60), f"c{rng.randrange(40):02}") for _ in range(260)] + [(99, f"c{i:02}") for i in range(12)] + [(None, "c01"), (7, None), (None, "c39"), (98, "alone")]
    df = spark.createDataFrame(lines + lines[:50], "request_id long, component string")
    pairs = df.distinct()
    want = sorted(map(tuple, clusters.average_linkage(pairs.select(pairs.component.alias("name")), graph.cooccurrence(pairs)).collect()), key=lambda r: r[0])
    assert sorted(map(tuple, clusters.request_linkage(df).collect())) == want and len(want) == 41
    for name, value in {"LOCAL_CLUSTERS": 9, "WIDE": 6, "FEW_LABELS": few}.items():
        monkeypatch.setattr(clusters, name, value)
    written, write = [], clusters.materialised
    monkeypatch.setattr(clusters, "materialised", lambda df, label, *a: (written.append(label), write(df, label, *a))[1])
    assert sorted(map(tuple, clusters.request_linkage(df).collect())) == want
    assert written.count("cluster-merges") > 2 and (written.count("cluster-pairs") == 1 if few else "cluster-rows" not in written)


def test_parts_are_named_by_their_least_member(spark):
    rng = random.Random(5)
    edges = [tuple(sorted(rng.sample(range(90), 2))) for _ in range(70)] + [(100 + i, 101 + i) for i in range(15)] + [(120, 140), (121, 140), (122, 140)]
    names = list(range(145))
    at = {i: i for i in names}
    for _ in names:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    found = clusters.parts_of(spark.createDataFrame([(i,) for i in names], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.part for r in found.collect()} == at


def test_rows_of_one_cluster_stay_together():
    import numpy as np
    import pyarrow as pa

    pairs = {(i, j): i + j for i in range(9) for j in range(i + 1, 9) if (i * j) % 3 != 1}
    both = sorted([(a, b, s) for (a, b), s in pairs.items()] + [(b, a, s) for (a, b), s in pairs.items()])
    ids, to, s = (np.array(x) for x in zip(*both))
    batch = pa.RecordBatch.from_pydict({"id": ids, "to": to.astype(np.int32), "s": s})
    same, none, size = np.arange(9, dtype=np.int32), np.zeros(9, bool), np.ones(9, np.int64)
    rows = [clusters.gathered(*x, same, size, none) for x in clusters.entries(iter([batch.slice(i, 4) for i in range(0, len(ids), 4)]), 6)]
    assert sorted(i for x in rows for i in x.column("id").to_pylist()) == sorted(set(ids.tolist()))
    back = [tuple(r.values()) for x in clusters.unpacked(iter([x.slice(1) for x in rows] + [x.slice(0, 1) for x in rows])) for r in x.to_pylist()]
    assert sorted(back) == sorted((a, b, s) for (a, b), s in pairs.items())
