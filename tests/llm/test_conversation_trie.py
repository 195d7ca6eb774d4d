import hashlib
import random
import re
import zlib
from collections import defaultdict

from tracemill.llm import conversation_trie as trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    inner = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))

    def roll(n):
        below = [roll(m) for m in inner[n]]
        own = (len(nodes[n]) - 1) * words(n[-1][1]) if n else 0
        return sum(x for x, _ in below) or 1, own + sum(x for _, x in below)

    for n, members in nodes.items():
        ends = sorted(c for c in members if built[c] == n)
        yield (min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(inner[n]), *roll(n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())


def rows(df):
    return sorted(map(tuple, df.select(*trie.COLUMNS).collect()), key=repr)


def built(df):
    return trie.trie(trie.shared_heads(trie.turns(df)))


def test_whole_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows(trie.query(spark, SF))
    assert got == sorted(brute(data), key=repr)
    assert max(r[3] for r in got[1:]) > 1


def test_copies_deep_ties_and_small_limits(spark, monkeypatch):
    rng = random.Random(3)
    data = []
    deep = [("user" if k % 2 else None, f"turn {k}\tof many") for k in range(9)]
    for c in range(60, 200):
        kind = rng.randrange(4)  # a copy, a beginning of one, one with another end, or an own text
        turns = {0: deep, 1: deep[: rng.randrange(1, 9)], 2: deep[:8] + [("user", f"end {c % 3}")], 3: [("user", f"{c} {k}") for k in range(rng.randrange(1, 6))]}[kind]
        data += [(c, k * 3 - 4, r, t) for k, (r, t) in enumerate(turns)]
    data += [(c, k, r, t) for c in range(1000, 1060) for k, (r, t) in enumerate(deep)]  # a third of all rows are copies
    for name in ("FEW", "HOT", "BLOCK", "CHUNK"):
        monkeypatch.setattr(trie, name, 4)
    assert rows(built(spark.createDataFrame(data, TURNS))) == sorted(brute(data), key=repr)


def test_odd_rows(spark):
    data = [
        (None, 0, "user", "no conversation"), (40, None, None, None), (40, None, "", "first of two"), (40, None, "", "first of two"), (40, 7, "a", " \t\n"), (41, 1, "a", "x" * 300_000), (-3, 1, "a", "b c"), (-3, 1, "ab", " c"),
        (59, 0, "user", "own"), (59, 1, "user", "own"), (59, 2, "user", "own"), (59, 3, "user", "own"), (60, 0, "é", "中 文"),
    ]
    df = spark.createDataFrame([(*x, "m", 1) for x in data], TURNS + ", words string, depth int")
    assert rows(built(df)) == sorted(brute(data), key=repr)
    assert built(df.limit(0)).count() == 0
    one = [(7, 0, "user", "alone")]
    assert rows(built(spark.createDataFrame(one, TURNS))) == sorted(brute(one), key=repr)
