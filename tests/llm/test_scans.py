import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tracemill.llm import decontaminate, licenses, packing, quality, secrets, token_counts

SF = "/root/testdata/sf0.001"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute_leaks(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = {}
    for i, t in items:
        w = word.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    for d, t in docs:
        w, hit, ids = word.findall(lower(t or "")), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[x]
        yield d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def order(rows):
    return sorted(rows, key=repr)


def test_decontamination_equals_brute_force(spark, documents):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in decontaminate.query(spark, SF).collect()]
    assert order(got) == order(brute_leaks(documents, items))
    assert any(r[5] for r in got)


def test_decontamination_odd_rows_and_blocks(spark, odd):
    items = spark.createDataFrame([(1, "lazy dog"), (2, "OVER the lazy-dog AGAIN and again jumps fox quick the word"), (3, None), (4, ""), (1, "lazy dog"), (5, "中文")], "item_id long, text string")
    want = order(brute_leaks([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()], items.collect()))
    for chars in (1, 1000):
        found = decontaminate.find_leaks(odd, items, block_chars=chars)
        assert order((r.doc_id, r.n_words, sum(b - a for a, b in r.ranges), len(r["items"])) for r in found.collect()) == order(x[:4] for x in want)
        for r in found.collect():
            for a, b in r.spans:
                assert re.fullmatch("(?is)lazy dog|中文", r.text[a:b])
    assert decontaminate.find_leaks(odd, items.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.decontaminate(odd, items).columns == odd.columns
    assert decontaminate.find_leaks(odd.limit(0), items).count() == 0


def brute_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def brute_entropy(v, w=20):
    best = 0.0
    for k in range(len(v) - w + 1):
        p = np.array(list(Counter(v[k : k + w]).values())) / w
        best = max(best, float(-(p * np.log2(p)).sum()))
    return best


def brute_added(t, base):
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or ""):
        v = m[0]
        if any(b[0] < m.end() and m.start() < b[2] for b in base) or not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or re.search(secrets.ALLOWED.replace("(?i)", ""), v, re.I):
            continue
        if brute_entropy(v) >= (3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) else 3.7):
            yield m.start(), 3, m.end(), "entropy"


SECRET_TEXTS = ["AKIA" + "A1B2" * 5 + " token=abc, secret: 'abcdef'", "api_key=token:abcdef x=y", "ñandú password = \"hunter22\" 0123456789abcdef0123456789abcdef", "key Zx9Qm2Lr7Tb4Vn8Wc5Kd1 and Zx9Qm2Lr7Tb4Vn8EXAMPLE", "👍 secret==a.b-c_d " * 50, "passwd=" + "q" * 30_000, "g7Hk2mQ9xZr4Tn8Vb3Lw" * 20, "ABCDEF0123456789FEDCBA98"]


def test_secrets_equal_brute_force(spark, documents, odd):
    texts = documents + [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()] + [(100 + i, t) for i, t in enumerate(SECRET_TEXTS)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = secrets.find_secrets(df).collect()
    n = 0
    for r in got:
        base = brute_secrets(r.text)
        assert [(x.start, x.ord, x.end, x.kind) for x in r.base] == base
        added = list(brute_added(r.text, base))
        assert [(x.start, x.ord, x.end, x.kind) for x in r.added] == added
        n += len(added)
    assert n >= 2 and len(got) == len(texts)
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    for r in secrets.find_secrets(clean).collect():
        assert not r.base, r.text
    whole = {r.doc_id: r for r in secrets.redact(odd).collect()}
    assert whole[7].text.startswith("é è ü") and whole[7].text.endswith("<|endoftext|> end") and "[SECRET]" in whole[7].text and whole[7].mark == "h" and whole[0].text is None


def brute_quality(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_rules_equal_brute_force(spark, documents, odd):
    extra = [(200, "a b c " * 500), (201, "\n".join(["l one two", "", "l one two", " ", " "] * 30)), (202, " ".join(f"{i % 300} {i % 7} z" for i in range(3000)))]
    texts = documents + [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()] + extra
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.rate(spark.createDataFrame(texts, "doc_id long, text string"), labels).collect()
    assert order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == order((i, *brute_quality(t)) for i, t in texts)
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)
    few = quality.FEW
    try:
        quality.FEW = -1
        again = quality.with_rules(quality.with_words(spark.createDataFrame(texts, "doc_id long, text string"))).collect()
    finally:
        quality.FEW = few
    assert order((r.doc_id, r.n_repeat_words) for r in again) == order((r.doc_id, r.n_repeat_words) for r in got)


def test_quality_ratios():
    assert quality.ratios([5, 5], [0, 0]) == [0.0, 0.0]
    up, down = quality.ratios([50, 50], [40, 0], prior=1.0)
    assert up > 0 > down


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, documents, odd, tokenizer):
    extra = [(300, "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30), (301, "<|endoftext|><|endoftext|> x"), (302, "   \n\n  tabs\t\t\tand 1234567890 it's we'll"), (303, "ababababab" * 999)]
    texts = documents + [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()] + extra
    got = token_counts.count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in texts]
    assert order(map(tuple, got)) == order(want)


def test_packing_is_whole_and_tight(spark, documents, odd, tokenizer):
    texts = documents + [(1000 + i, r[1]) for i, r in enumerate(odd.select("doc_id", "text").collect())]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(by_doc[i]) == 1)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) <= -(-sum(r.length for r in got) // 1024) * 1.02 + 1


@pytest.mark.parametrize("text", [" " * 5_000_000, "a" * 5_000_000, "中" * 1_700_000, "\n" * 1_000_000 + "x " * 500_000, "one <|endoftext|>" + " " * 1_000_000 + "two"], ids=["blanks", "letter", "cjk", "mixed", "special"])
def test_packing_takes_very_long_runs(text, tokenizer):
    assert packing.encode(text, P.path("byte_bpe_50k.json"), P.PATTERN) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1])
def test_packing_ids_are_the_same_on_both_ways(n, tokenizer):
    for text in ("a " * 9 + " " * n + "b", "x" * n + " <|endoftext|> y", "é" * n + "\n\n" + "  z"):
        assert packing.encode(text, P.path("byte_bpe_50k.json"), P.PATTERN) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 40), rng.integers(1, 200, 40), strict=True)}
    bins, seen = {}, Counter()
    for length, rank, n, first, per, offset in packing.make_plan(hist, 64):
        for k in range(n):
            bins.setdefault(first + k // per, []).append((offset + k % per * length, length))
        assert seen[length] == rank
        seen[length] += n
    assert seen == hist
    for rows in bins.values():
        at = 0
        for o, length in sorted(rows):
            assert o == at
            at += length
        assert at <= 64


def test_licenses(spark, documents, odd):
    rows = licenses.template_rows()

    def brute(t):
        t, out = t or "", []
        whole = [x for x in (" ".join(licenses.normalise(x)) for x in re.split("\n[\x20\x09\x0d]*\n", t)) if x]
        for u in {*(" ".join(licenses.normalise(x)) for x in t.split("\n")), *(" ".join(whole[i : i + k]) for k in range(1, licenses.RUN + 1) for i in range(len(whole) - k + 1))}:
            w = u.split()
            p = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
            best = min(((-2 * len(p & set(q)) / (len(p) + len(q)), name) for name, q in rows), default=None)
            if p and -best[0] >= licenses.THRESHOLD:
                out.append((best[1], round(-best[0], 9)))
        return sorted(out)

    extra = [(400, "x\n\n" + licenses.TEMPLATES["MIT"][1].replace(", ", ",\n") + "\n\ny"), (401, "released under an MIT license"), (402, "Licensed under CC BY-NC 4.0."), (403, licenses.TEMPLATES["MIT"][1].replace(": The above", ":\n\nThe above")), (404, licenses.TEMPLATES["BSD-3-Clause"][1].replace(": Re", ":\n\n1. Re").replace("disclaimer. Re", "disclaimer.\n \n2. Re")), (405, "This work is licensed under the GNU General Public License, version 3.")]
    texts = documents + [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()] + extra
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert order((r.doc_id, sorted((x.license, round(x.dice, 9)) for x in r.found)) for r in got) == order((i, brute(t)) for i, t in texts)
    found = {r.doc_id: {x.license for x in r.found} for r in got}
    assert found[400] == found[403] == {"MIT"} and found[402] == {"CC-BY-NC-4.0"} and found[404] == {"BSD-3-Clause"} and found[405] == {"GPL-3.0"}


def test_secrets_in_long_texts_and_clashing_columns(spark):
    import time

    many = " ".join(f"{i:024x} token=abc{i:07d}," for i in range(100_000))
    dump = " ".join(["k" + "Zx9Qm2Lr7Tb4Vn8Wc5Kd1", "0" * 20 + "abcdef0123456789"] * 2_000)
    df = spark.createDataFrame([(1, many, 1), (2, dump, 2), (3, None, 3), (4, "x", 4)], "doc_id long, text string, n_chars int").selectExpr("*", "'b' as base", "doc_id as added", "'t' as t", "'r' as row", "text as spans", "1 as _t", "2 as assign")
    began = time.time()
    got = {r.doc_id: r for r in secrets.find_secrets(df.select("doc_id", "text")).collect()}
    assert len(got[1].base) == 200_000 and time.time() - began < 30
    assert [(x.start, x.ord, x.end, x.kind) for x in got[1].base] == brute_secrets(many)
    assert [(x.start, x.ord, x.end, x.kind) for x in got[2].added] == list(brute_added(dump, brute_secrets(dump)))
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert (r.base, r.added, r.t, r.row, r._t, r["assign"]) == ("b", r.doc_id, "t", "r", 1, 2)
        if r.doc_id == 1:
            assert r.text == "[SECRET] [SECRET], " * 99_999 + "[SECRET] [SECRET]," and r.n_chars == len(r.text)
    assert secrets.redact(df.limit(0)).count() == secrets.find_secrets(df.limit(0)).count() == 0


def test_clashing_columns_come_back(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog again", 5), (2, "Released under the MIT License.", 6), (3, None, 7)]
    names = ["items", "ranges", "spans", "n_words", "score", "row", "_t", "_w", "_n", "t", "n", "units", "sets", "some", "paragraphs", "base_failed"]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in names], "concat('k', doc_id) as kept")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "Nothing of it")], "item_id long, text string")
    want = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, decontaminate.decontaminate(df, items).collect())) == want
    assert sorted(map(tuple, licenses.scan(df).drop("found").collect())) == want
    assert sorted(map(tuple, secrets.redact(df).collect())) == want
    assert quality.accepted(df, labels).columns == df.columns
    rated = {r.doc_id: r for r in quality.rate(df, labels).collect()}
    assert rated[2].items == "items2" and rated[2]["t"] == "t2" and rated[2].n_words == 5
    assert decontaminate.decontaminate(df.limit(0), items).count() == licenses.scan(df.limit(0)).count() == quality.rate(df.limit(0), labels).count() == 0
