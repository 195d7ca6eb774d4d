import random
from collections import Counter, defaultdict

import pytest

from tracemill.operators import resolver, skew

SYMBOLS, REFERENCES, OVERRIDES = "id long, name string, file string, lang string, parent string", "src long, ref string, kind string", "src long, dst long, kind string"


def stem(file):
    return file.replace("\\", "/").rsplit("/", 1)[-1].split(".")[0]


def dirs(file):
    return file.replace("\\", "/").split("/")[:-1]


def plain(symbols, references, overrides, most=8, uses=25):
    """One reference after the other, over lists of candidates."""
    by_id, by_name = {s[0]: s for s in symbols}, defaultdict(list)
    for s in sorted(symbols):
        by_name[s[1]].append(s)
    owned = set(by_name) | {stem(s[2]) for s in symbols}
    edges, staged, stats = set(), [], Counter()

    def target(src, ref, kind):
        receiver, _, name = ref.rpartition(".")
        root, dotted = receiver.split(".")[0], "." in ref
        through = receiver != "" and root not in ("self", "cls", "this")
        cands = [c for c in by_name[name] if not (through and kind == "invoke" and c[0] == src)]
        file = by_id[src][2]
        if through and (named := [c for c in cands if stem(c[2]) == root]):
            return named[0][0]
        same = [c for c in cands if c[2] == file]
        if dotted and name in resolver.LIBRARY_NAMES:
            return same[0][0] if len(same) == 1 else None
        if same:
            return same[0][0]
        if len(cands) == 1:
            return cands[0][0]
        depth = {c[0]: next((i for i, (a, b) in enumerate(zip(dirs(c[2]), dirs(file), strict=False)) if a != b), min(len(dirs(c[2])), len(dirs(file)))) for c in cands}
        best = max(depth.values(), default=0)
        near = [c for c, d in depth.items() if d == best]
        return near[0] if best and len(near) == 1 else None

    overrides = [o for o in overrides if o[0] in by_id and o[1] in by_id]
    edges |= {o for o in overrides if o[0] != o[1]}
    settled = {(o[0], by_id[o[1]][1]) for o in overrides}
    for s in symbols:
        if s[4] is not None and (p := target(s[0], s[4], "contains")) not in (None, s[0]):
            edges.add((p, s[0], "contains"))
    for src, ref, kind in sorted({r for r in references if r[0] in by_id and r[1] is not None}):
        receiver, _, name = ref.rpartition(".")
        root = receiver.split(".")[0]
        through = receiver != "" and root not in ("self", "cls", "this")
        if kind == "invoke" and (src, name) in settled:
            continue
        to = target(src, ref, kind)
        if to is not None:
            if to != src:
                edges.add((src, to, kind))
        elif kind == "invoke" and len(by_name[name]) > 1:
            same = [c[0] for c in by_name[name] if c[3] is not None and c[3] == by_id[src][3]]
            if through and root not in owned:
                stats["external_receiver"] += 1
            elif not same:
                stats["cross_lang"] += 1
            elif len(same) == 1:
                stats["resolved_by_lang"] += 1
                if same[0] != src:
                    edges.add((src, same[0], "invoke"))
            elif len(same) > most:
                stats["generic_name"] += 1
            else:
                staged.append((src, ref, name, through, same))
    calls = Counter(s[2] for s in staged if s[3])
    pending = set()
    for src, ref, name, through, same in staged:
        if through and calls[name] >= uses and calls[name] > 2 * len(same):
            stats["library_method"] += 1
        else:
            pending.add((src, ref, tuple(same)))
    return edges, pending, stats


def results(graph):
    edges, pending, stats = graph
    found = [tuple(r) for r in edges.collect()]
    assert len(found) == len(set(found))
    return set(found), {(r.src, r.ref, tuple(r.candidates)) for r in pending.collect()}, {r.reason: r.n for r in stats.collect()}


@pytest.fixture(scope="module")
def repository():
    rng = random.Random(11)
    words = [f"f{i}" for i in range(60)] + ["get", "json", "format"] * 2
    files = [f"{'/'.join(rng.choices(['app', 'lib', 'core', 'web'], k=rng.randrange(4)))}{rng.choice(['/', chr(92), '/'])}{rng.choice(['user', 'store', 'f1', 'main', 'f2', 'x'])}{rng.choice(['', i])}.{rng.choice(['py', 'test.ts'])}" for i in range(300)]
    symbols = [(i, rng.choice(words) if i % 3 else f"s{i}", rng.choice(files), rng.choice(["py", "ts", "py", None]), rng.choice([None, None, "f1", "s3", "f2", "nobody"])) for i in range(900)]
    receivers = ["", "", "self.", "user.", "store.", "f1.", "f9.a.", "np.", "cls.b.", "x.y.z.", "."]
    refs = [(rng.randrange(905), rng.choice(receivers) + rng.choice([*words, "f1", "f2", f"s{rng.randrange(300) * 3}", "unknown"]), rng.choice(["invoke", "invoke", "inherit"])) for _ in range(6000)] + [(3, None, "invoke")]
    return symbols, refs, [(rng.randrange(905), rng.randrange(905), "invoke") for _ in range(50)]


def test_edges_pending_and_stats_equal_a_plain_resolver(spark, repository):
    symbols, refs, overrides = repository
    frames = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(refs, REFERENCES), spark.createDataFrame(overrides, OVERRIDES)
    for most, uses in ((8, 25), (3, 4)):
        edges, pending, stats = results(resolver.call_graph(*frames, max_candidates=most, library_references=uses))
        want = plain(symbols, refs, overrides, most, uses)
        assert edges == want[0] and pending == want[1] and stats == dict(want[2])
    assert len(stats) == 5 and pending and {e[2] for e in edges} == {"contains", "invoke", "inherit"}


def test_rules_one_by_one(spark):
    symbols = [
        (1, "run", "a/main.py", "py", None), (2, "save", "a/b/store.py", "py", "Store"), (3, "save", "a/c/other.py", "py", None), (4, "Store", "a/b/store.py", "py", None), (5, "save", "z/far.py", "py", None),
        (6, "get", "a/main.py", "py", None), (7, "near", "a/b/one.py", "py", None), (8, "near", "q/two.py", "py", None), (9, "caller", "a/b/deep/x.py", "py", None), (10, "tie", "a/b/m.py", "py", None), (11, "tie", "a/b/n.py", "py", None),
    ]
    refs = [(1, "store.save"), (1, "save"), (1, "session.get"), (9, "session.get"), (9, "near"), (9, "tie"), (2, "other.save"), (2, "x.save"), (1, "nothing"), (6, "far.save")]
    got = resolver.resolve(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([(*r, "invoke") for r in refs], REFERENCES)).collect()
    assert {(r.src, r.ref): (r.dst, r.rule) for r in got} == {
        (1, "store.save"): (2, "stem"), (1, "save"): (None, None), (1, "session.get"): (6, "file"), (9, "session.get"): (None, None), (9, "near"): (7, "nearest"), (9, "tie"): (None, None),
        (2, "other.save"): (3, "stem"), (2, "x.save"): (3, "nearest"), (1, "nothing"): (None, None), (6, "far.save"): (5, "stem"),
    }


def test_empty_repository_and_frequent_names(spark, repository, monkeypatch):
    symbols, refs, _ = repository
    none = spark.createDataFrame([], SYMBOLS)
    assert all(df.count() == 0 for df in resolver.call_graph(none, spark.createDataFrame(refs, REFERENCES)))
    assert resolver.call_graph(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([], REFERENCES))[1].count() == 0
    large = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id", "id % 7 AS j")
    small = spark.createDataFrame([("hot", 1, "a"), ("k1", 1, "b"), ("hot", 2, "c"), (None, 1, "d")], "k string, j long, v string")
    for how in ("inner", "left"):
        got = skew.spread_join(large, small, ["k", "j"], "k", how).select("k", "j", "id", "v")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, large.join(small, ["k", "j"], how).select("k", "j", "id", "v").collect()), key=repr)


def test_a_file_looks_a_name_up_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(resolver, "spread_join", lambda large, small, *rest: asked.append(large.count()) or skew.spread_join(large, small, *rest))
    symbols = spark.createDataFrame([(i, "f" if i < 2 else f"g{i}", f"a/{'m' if i else 'n'}.py", "py", None) for i in range(30)], SYMBOLS)
    refs = spark.createDataFrame([(i, f"x{k}.f", "invoke") for i in range(1, 30) for k in range(10)], REFERENCES)
    assert {(r.src == 1, r.dst) for r in resolver.resolve(symbols, refs).collect()} == {(True, 0), (False, 1)}
    assert asked == [4]  # file, all, language and one directory for all 290 references; one row of each for each reference before
