import re
from collections import Counter, defaultdict

import numpy as np

from tracemill.llm import collocations

SF = "/root/testdata/sf0.001"


def brute(rows, most=3, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, b in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= inside * counts[p[i : i + k]]}
        out = []
        for p, a in found.items():
            if p not in gone:
                score, _, le, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                out.append((-score, -a, " ".join(p).encode(), le, r))
        for rank, (score, a, p, le, r) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, p.decode(), -a, le, r, n[lang], -score


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_whole_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    got = rows(collocations.query(spark, SF))
    assert got == sorted(brute(data)) and len(got) > 50


def test_odd_rows(spark, odd):
    text = "New York, new york\tNEW  york. of new york city! of the\x0bof the of the; a a a a"
    data = [(None, text, 1, "f")] * 6 + [("und", text, 2, "g"), ("", "x y " * 50_000, 3, "h"), ("é", "é ü É Ü \x00 ü" * 9, 4, "i"), ("z", None, 5, "j"), ("z", " .,", 6, "k"), (None, "a b c d e", 7, "l")]
    df = spark.createDataFrame(data, "lang string, text string, score long, phrase string")
    for options in ({}, {"least": 2, "words": 4, "inside": 80, "top": 3}, {"least": 1, "words": 2}):
        want = sorted(brute([d[:2] for d in data], options.get("words", 3), options.get("least", 10), options.get("inside", 50), options.get("top", 2000)))
        assert rows(collocations.collocations(df, **options)) == want
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("lang = 'z'")).count() == 0


def test_parts_that_are_not_hot_and_large_counts(spark, monkeypatch):
    a, le, r = 900_000_000_000_001, 970_000_000_000_003, 910_000_000_000_007
    data = [("en", 0, "", 10**16), ("en", 1, "x", le), ("en", 1, "y", r), ("en", 2, "x y", a), ("en", 1, "z", 12), ("en", 2, "y z", 11), ("en", 3, "x y z", 10)]
    counts = spark.createDataFrame(data, "lang string, size int, phrase string, f long")
    for hot in (1, 10**9):
        monkeypatch.setattr(collocations, "HOT", hot)
        got = {r.phrase: tuple(r)[2:] for r in collocations.scored(counts).collect()}
        assert got["x y"] == (a, le, r, 10**6 * a * a // (le * r), 10)
        assert got["y z"] == (11, r, 12, 10**6 * 121 // (12 * r), 10)
        assert got["x y z"] == (10, le, 11, 0, None)


def test_slices_and_a_bucket_beyond_memory(spark, monkeypatch):
    piece = [b"a b a b a", b"b", "é a b".encode()]
    got = {(n, p): f for n, ps, fs, _ in collocations.ngrams(piece, np.array([2, 5, 1]), 3) for p, f in zip(ps.to_pylist(), fs.to_pylist(), strict=True)}
    assert got == {(1, "a"): 7, (1, "b"): 10, (1, "é"): 1, (2, "a b"): 5, (2, "b a"): 4, (2, "é a"): 1, (3, "a b a"): 4, (3, "b a b"): 2, (3, "é a b"): 1}
    many = spark.range(300_000).selectExpr("'en' AS lang", "concat('word ', id % 100000, ' of a long tail with ', id % 100000) AS text", "id AS doc_id").repartition(4)
    monkeypatch.setattr(collocations, "SLICE", 200_000)
    counts = collocations.frequent(many, 3, 3, "40MB")
    assert counts.where("size > 0").groupBy("size").count().collect() and counts.where("size = 0").agg({"f": "sum"}).first()[0] == 300_000 * 8
    assert {(r.size, r.n) for r in counts.where("size > 0").groupBy("size").agg({"f": "count"}).withColumnRenamed("count(f)", "n").collect()} == {(1, 100_006), (2, 300_004), (3, 300_003)}
