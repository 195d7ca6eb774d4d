import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tracemill.llm import html_text, near_dedup, suffix_tree_lm, toxicity

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """doc_id -> smallest doc_id reachable, by comparing all sets."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def test_near_dedup_equals_brute_force(spark, documents):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(300)]
    family = []
    for k in range(90):  # more than FREQUENT copies, some too far from others to be linked directly
        w = list(base)
        for at in rng.integers(0, 300, 1 + k % 7):
            w[at] = f"x{k}-{at}"
        family.append((5000 + k, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    shared = [(6000 + k, " ".join(f"d{k}-{i}" for i in range(40)) + " " + passage) for k in range(80)]
    rows = documents + family + shared + [(7000, None), (7001, ""), (7002, "one two"), (7003, "ONE  two"), (7004, "  ")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (want[r.doc_id] == r.doc_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id])) for r in got)


def test_family_bounds_lose_no_link(spark, monkeypatch):
    """A family most of whose members are just too far from each other, with a chain of links outside its largest component."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.choice(160, k % 16, replace=False):
            w[at] = f"x{k}-{at}"
        rows.append((8000 + k, " ".join(w)))
        if k % 16 > 8 and k % 3 == 0:  # a near copy of a far member
            w[(k * 7) % 160] = "again"
            rows.append((9000 + k, " ".join(w)))
    seen, bounded = [], near_dedup.family_pairs

    def watched(members, docs, width=5, **more):
        seen.append((members.count(), bounded(members, docs, width, **more).distinct().count()))
        return bounded(members, docs, width, **more)

    monkeypatch.setattr(near_dedup, "family_pairs", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows) and seen and seen[0][1] < seen[0][0] ** 2 / 8
    # Against single components the bounds must keep every link.
    sets = {i: shingles(t) for i, t in rows}
    members = spark.createDataFrame([(8000, i, len(x), i) for i, x in sets.items()], "family long, rep long, n long, component long")
    kept = {tuple(r)[:2] for r in bounded(members, docs).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links and links <= kept


def test_pipeline_stage_links_from_eighty_percent(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    copy = lambda n: " ".join(base[: 104 - n] + [f"x{n}-{i}" for i in range(n)])  # noqa: E731  100 - n of 100 + n are common
    docs = spark.createDataFrame([(1, " ".join(base)), (2, copy(10)), (3, copy(14)), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {1, 3, 4}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_near_dedup_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} >= {(4, 4, True), (5, 4, False), (0, 0, True), (None, None, True)}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    assert near_dedup.deduplicate(odd).columns == odd.columns


def test_lm_base_is_exact_and_model_is_better(spark, documents, odd):
    rows = documents + [(9000 + i, r[1]) for i, r in enumerate(odd.select("doc_id", "text").collect())]
    got = {r.doc_id: r for r in suffix_tree_lm.score(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows + rows[:3] if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        r, w = got[i], toks(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert suffix_tree_lm.score(odd.limit(0)).count() == 0


def brute_tree_scores(texts, new):
    """log10 scores of ``new`` by a tree of nested counts, without hashes, ranges, joins or bitmaps; and the retained contexts."""
    lm = suffix_tree_lm
    counts = Counter(w for t in texts for w in [*t.split(), None])
    total = sum(counts.values())
    seen = defaultdict(Counter)
    for t in texts:
        w = ["^", *t.split()]
        for k, x in enumerate([*w[1:], None], 1):
            for d in range(1, k + 1):
                seen[tuple(w[k - d : k])][x] += 1

    def root(x):
        return (counts[x] - lm.DISCOUNT) / total if x in counts else lm.DISCOUNT * len(counts) / total

    stays = {}

    def p(c, x):
        if not c:
            return root(x)
        if c not in stays:
            return p(c[1:], x)
        return own(c, x)

    def own(c, x):
        n = sum(seen[c].values())
        shown = {y: k for y, k in seen[c].items() if k >= lm.CUT}
        free = 1 - sum(k - lm.DISCOUNT for k in shown.values()) / n
        return ((shown[x] - lm.DISCOUNT) / n if x in shown else 0) + free * p(c[1:], x)

    tried, depth = [c for c in list(seen) if len(c) == 1 and sum(seen[c].values()) >= lm.LEAST], 1
    while tried:
        fresh = []
        for c in tried:
            gain = sum(k * math.log(own(c, x) / p(c[1:], x)) for x, k in seen[c].items())
            if gain > lm.MIN_GAIN and gain > lm.MIN_DIVERGENCE * sum(seen[c].values()) and max(seen[c].values()) >= lm.CUT:
                fresh.append(c)
        stays |= dict.fromkeys(fresh, True)
        tried = [(*c, x) for c in tried for x, k in seen[c].items() if k >= max(lm.LEAST, lm.CUT) and x is not None and (*c[1:], x) in stays and (len(c) == 1 or c[1:] in stays)]
    return [sum(math.log10(p(tuple(w[:k]), x) if (w := ["^", *t.split()]) else 0) for k, x in enumerate([*t.split(), None], 1)) for t in new], stays


def test_tree_grows_by_evidence_and_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(900):
        w = list(rng.choice(words, 60))
        if i % 180 == 2:
            w[10:12] = ["seldom", "follower"]  # five times
        if i % 10 == 0:
            w[20:25] = ["w1", "w2", "w3", "w5", "deep"]
        if i % 10 == 1:
            w[20:25] = ["w4", "w2", "w3", "w5", "other"]
        texts.append(" ".join(w))
    texts[0] += " once"
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 != 2][:900]
    held = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    new = ["w9 seldom follower w7", "w1 w2 w3 w5 deep", "w4 w2 w3 w5 other w5 unseen", "seldom w1", ""]
    rows = [*zip(ids, texts, strict=True), *zip(held, new, strict=True)]
    monkeypatch.setattr(suffix_tree_lm, "MIN_DIVERGENCE", 0.1)
    want, stays = brute_tree_scores(texts, new)
    assert stays["seldom",] and max(map(len, stays)) >= 4
    docs = spark.createDataFrame([*rows, rows[-2]], "doc_id long, text string").selectExpr("*", "1 as row", "'x' as part", "2 as task").repartition(3)
    for most in (suffix_tree_lm.HOT_KEYS, 40, 0):  # all terms broadcast, some, all looked up
        monkeypatch.setattr(suffix_tree_lm, "HOT_KEYS", most)
        got = {r.doc_id: r.score for r in suffix_tree_lm.score(docs, parts=8).collect()}
        assert np.allclose([got[i] for i in held], want, rtol=1e-9)


def test_texts_are_scored_in_rounds_with_the_same_results(spark, documents, monkeypatch):
    """the look-ups of all texts are never on disk at once."""
    docs = spark.createDataFrame([*documents, documents[0], (None, "no id")], "doc_id long, text string")
    kept, keep = [], suffix_tree_lm.keep
    monkeypatch.setattr(suffix_tree_lm, "keep", lambda df, label, *a, **b: (kept.append(label), keep(df, label, *a, **b))[1])
    seen = {}
    for waves in (1, 3):
        kept.clear()
        monkeypatch.setattr(suffix_tree_lm, "WAVES", waves)
        seen[waves] = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree_lm.score(docs, parts=8).collect())
        assert sum(x.startswith("lm-scores") for x in kept) == waves - 1
        assert not any(x.startswith("tree-rated") for x in kept)
    assert seen[1] == seen[3] and len(seen[1]) == len(documents) + 2


def test_words_of_no_bytes_and_of_zeros_differ():
    words = [b"a" + bytes(k) for k in range(20)] + [bytes(k) for k in range(1, 20)]
    assert len({int(x) for x in suffix_tree_lm.word_hashes(b" ".join(words))[0]}) == len(words)


def test_tree_probabilities_sum_to_one(spark):
    texts = ["a b c a b d"] * 6 + ["b a c"] * 5 + ["a a b"] * 4
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 == 2]
    ends = ["", "a", "b", "c", "d", "unseen"]
    rows = [*zip(ids, texts, strict=True), *((h, f"a b {e}".strip()) for h, e in zip(held, ends, strict=False))]
    got = {r.doc_id: r for r in suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), parts=8).collect()}
    want, _ = brute_tree_scores(texts, [f"a b {e}".strip() for e in ends])
    assert np.allclose([got[h].score for h in held[:6]], want)


def test_word_hashes_are_those_of_single_words(monkeypatch):
    texts = [b"", b" A b\tcc\x0b\n A", b"x" * 5000 + b" y", "é 中文 a\u00a0b".encode(), b"cc cc", b"q" * 2500]
    one = lambda w: suffix_tree_lm.word_hashes(w)[0][0]
    want = [x for t in texts for x in [suffix_tree_lm.BEFORE, *map(one, t.lower().split()), suffix_tree_lm.AFTER]]
    for step in (suffix_tree_lm.STEP, 1000, 7):
        monkeypatch.setattr(suffix_tree_lm, "STEP", step)
        h, n = suffix_tree_lm.read(texts)
        assert h.tolist() == want and n.tolist() == [len(t.split()) for t in texts]
    words = {bytes(w) for w in np.random.default_rng(2).integers(97, 102, (200_000, 9)).astype(np.uint8)} | {b"a" * k for k in range(1, 300)}
    assert len({int(x) for x in suffix_tree_lm.word_hashes(b" ".join(words))[0]}) == len(words)


def test_tree_keys_come_back():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2)
    assert (suffix_tree_lm._unmix(near_dedup._mix(x)) == x).all()


def test_packed_entries_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        rows = np.zeros(n, suffix_tree_lm.ENTRY)
        rows["context"] = rng.choice(rng.integers(0, (1 << 64) - 1, 200, np.uint64), n)
        rows["next"], rows["n"] = rng.integers(0, (1 << 64) - 1, n, np.uint64), rng.integers(1, 1 << 32, n)
        packed = suffix_tree_lm.packed_entries(rows, 64)
        assert all((suffix_tree_lm.part_of(suffix_tree_lm.unpacked_entries(suffix_tree_lm._batch([b]))["context"], 64) == b[1]).all() for b in packed)
        order = ["context", "next", "n"]
        assert (np.sort(suffix_tree_lm.unpacked_entries(suffix_tree_lm._batch(packed)), order=order) == np.sort(rows, order=order)).all()


def test_toxicity_restores_disguised_words():
    m = toxicity.Letters(dict.fromkeys(["idiot", "moron", "stupid", "loser", "table", "the", "hello", "other"], 50))
    r = toxicity.Reader(m)
    assert [r.word(w) for w in ("1d10t", "m0r0n", "stuuuupid", "l.o.s.e.r", "table,")] == ["idiot", "moron", "stupid", "loser", "table"]
    assert "idiot" in r.words("you i d i o t there")


def test_toxicity_restores_long_and_joined_disguises():
    r = toxicity.Reader(toxicity.Letters(dict.fromkeys(["you", "are", "an", "idiot", "moron", "table", "the", "hello", "other"], 50)))
    assert r.word("idi" + "o" * 64 + "t") == "idiot" and r.word("m" + "o" * 30_000 + "ron") == "moron"
    for text in ("you i d i o t.", "i d i o t, go", "(i d i o t)", "so: i.d.i.o.t!"):
        assert "idiot" in r.words(text), text
    assert {"you", "idiot"} <= r.words("y o u i d i o t")
    long = " ".join("youareanidiot" * 40)
    assert {"you", "are", "an", "idiot"} <= r.words(long)


def test_toxicity_held_out(spark):
    bad, rows, labels = ["idiot", "moron", "loser"], [], []
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "ze") for b in ("la", "mu", "ne", "po") for c in ("r", "s", "n", "t")]
    for i in range(600):
        w = list(rng.choice(words, 30))
        if i % 5 == 1:
            w[3] = bad[i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 1)))
    rows += [(1000, None), (1001, ""), (1002, "y0u 1d10t"), (None, "x")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.rate(docs, lab).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == t for i, t in labels) and got[1002].predicted == 1 and got[1001].predicted == got[1000].predicted == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert {r.score for r in toxicity.rate(docs, lab.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_learns_from_all_labelled_rows(spark):
    """no sample of the labels."""
    docs = spark.range(26_000).selectExpr("id AS doc_id", "'some text' AS text")
    rows = toxicity._training(docs, docs.selectExpr("doc_id", "CAST(doc_id % 9 = 0 AS INT) AS toxic"))
    assert rows.count() == docs.where("crc32(CAST(doc_id AS STRING)) % 5 <> 0").count() > 20_000
    few = toxicity.logistic(np.array([0.0, 2.0, 2.0]), np.array([0.0, 0.0, 1.0]), np.array([9.0, 1.0, 4.0]))
    assert np.allclose(few, toxicity.logistic(np.array([0.0] * 9 + [2.0] * 5), np.array([0.0] * 9 + [0.0] + [1.0] * 4), np.ones(14)))


def test_toxicity_training_shuffles_labelled_texts_alone(spark):
    docs = spark.range(-10_000, 10_000).selectExpr("id AS doc_id", "'some text' AS text").union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    labels = docs.where("doc_id % 9 = 0").selectExpr("doc_id", "1 AS toxic")
    some = toxicity._likely(docs, labels.select("doc_id"))
    assert some.join(labels, "doc_id").count() == labels.count() <= some.count() < labels.count() + 100
    assert toxicity._likely(docs, labels.select("doc_id").limit(0)).count() == 0
    plan = toxicity._training(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan.lower()  # small labels are joined as large ones are


def test_toxicity_remembered_strengths_equal_those_of_words(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    letters = toxicity.Letters(dict.fromkeys(["you", "are", "an", "idiot", "moron", "table", "the", "hello", "other"], 50))
    odds = {"idiot": 3.0, "othe~": 2.5, "the": 2.0}
    strength, reader = toxicity.Strength(toxicity.Reader(letters), odds), toxicity.Reader(letters)
    texts = ["", "the table", "«Others!»", "hello 1d10t, the", "oooother", "i d i o t.", "you are an other and the one", "a b", "idi0t!", "tha~ THE~"]
    assert [strength.of(t) for t in texts] == [toxicity.evidence(reader.words(t), odds) for t in texts] == [0, 2, 2.5, 3, 2.5, 3, 2.5, 0, 3, 2]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li>menu</ul></nav><div class="cookie-notice">Cookies!</div><div id=content><article><header><h1>Title &amp; more</h1></header><p><b>One
 two<br><p>Three&nbsp;four &lt;x&gt;</p><ul><li>a<li>b</ul><div class="ad">buy</div><form><input>go</form><section class="comments"><p>first!</p></section></article></div><aside>side</aside><footer>&copy; me</footer>"""


def test_html_main_text():
    assert html_text.blocks(html_text.roots(html_text.parse(PAGE)), set()) == ["Title & more", "One two", "Three four <x>", "a", "b"]
    assert html_text.blocks(html_text.roots(html_text.parse("<div>" * 30_000 + "deep <b>text")), set()) == ["deep text"]
    assert html_text.blocks(html_text.roots(html_text.parse("a < b & c &am <p title=\"x>y\">z</p>")), set()) == ["a < b & c &am", "z"]


def test_html_templates_go_and_articles_stay(spark):
    rows = [(i, f"http://h.example.com/{i}", f"<body><div><span>Join our club</span></div><div>Own text of page {i}</div><p>Same line on all pages</p></body>") for i in range(8)]
    rows += [(100 + i, f"http://g.example.com/{i}", "<article><h1>Copy</h1><div>all the same text</div></article>") for i in range(8)]
    rows += [(200, None, "<p>no url</p>"), (201, "http://h.example.com/x", None), (202, "", ""), (0, rows[0][1], rows[0][2])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[3] == "Own text of page 3\nSame line on all pages" and text[104] == "Copy\nall the same text"
    assert (text[200], text[201], text[202]) == ("no url", "", "") and all(r.n_chars == len(r.text) for r in got)


def test_html_boxes_of_layouts_go(spark):
    words = [f"{a}{b}" for a in ("ra", "to", "mi", "ke") for b in ("lon", "sip", "dar", "vun")]
    own = lambda i: " ".join(words[(i * k + k) % 16] for k in range(2, 14)) + f" number {i}"
    rows, want = [], {}
    for i in range(40):
        box = ("Join the club today", "Opening hours nine to five", None, None)[i % 4]  # each on a quarter of the pages
        side = f"<div><div>{box}</div></div>" if box else f"<div>Aside {i} of its own</div>"
        text = f"{own(i)} is <b>{'not' if i % 3 == 1 else f'number {i}'}</b> late"
        rows.append((i, f"http://h.example.com/{i}", f"<body><div>{text}</div>{side}</body>" if i % 3 else f"<body>{side}<article><div>{text}</div></article></body>"))
        want[i] = text.replace("<b>", "").replace("</b>", "") + ("" if box or not i % 3 else f"\nAside {i} of its own")
    # A text that is most of its page stays, though six pages differ only in a line under it; so does a bold word on a few pages.
    rows += [(100 + i, f"http://h.example.com/c{i}", f"<body><div>{own(77)}</div><div>Seen {i}</div></body>") for i in range(6)]
    want |= {100 + i: f"{own(77)}\nSeen {i}" for i in range(6)}
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_of_the_table(spark):
    import html as entities
    import re

    got = {r.page_id: r.text for r in html_text.query(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_pipeline(spark, documents):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert kept is None or ids <= kept
        assert name != "secrets" or ids == kept
        kept = ids
    assert not [1 for i, c in brute_components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]).items() if i != c]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == kept and kept
    seen = defaultdict(int)
    for r in pieces:
        seen[r.sequence_id] += r.length
    assert max(seen.values()) <= 1024


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, name):
    docs = odd.selectExpr("doc_id", "text", "'en' as lang", "mark as source", "length(text) as n_chars")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs, SF).count() <= docs.count() * 200
    assert stage(spark, docs.limit(0), SF).count() == 0
