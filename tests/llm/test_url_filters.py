import random
import re

from tracemill.llm import url_filters

SF = "/root/testdata/sf0.001"
RULES = "host string, path string, verdict string"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute(pages, rules, default="allow"):
    rules = [(lower(h), p, v) for h, p, v in rules if h is not None and p is not None and v in ("allow", "block")]
    for page, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        yield page, host, path, best and best[3], best[2] if best else default


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark):
    got = rows(url_filters.query(spark, SF))
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    assert got == sorted(brute(pages, url_filters.RULES), key=repr)
    assert len({r[3] for r in got}) > 2


def test_nested_rules_and_many_ranges(spark):
    rng = random.Random(5)
    hosts = [".".join(rng.choices(["a", "b", "ab", "c", "a-b", "é"], k=k)) for k in range(1, 6) for _ in range(12)]
    paths = ["/" + "/".join(rng.choices(["x", "y", "xy"], k=k)) + rng.choice(["", "/"]) for k in range(5) for _ in range(5)]
    rules = [(rng.choice(hosts), rng.choice([*paths, "", "/"]), rng.choice(["allow", "block"])) for _ in range(150)] + [("", "/y", "block"), ("A.B", "/", "block")]
    urls = [(i, f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice([*hosts, 'hot.a.b', 'hot.a.b', 'A.b'])}{rng.choice([*paths, '', '?q=/x', '#://'])}{rng.choice(['', '?a', '#b', '/z'])}") for i in range(3000)]
    urls += [(9000, "http://hot.a.b/x/")] * 1500  # one url holds a third of all rows
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = rows(url_filters.judge(pages, spark.createDataFrame(rules, RULES)))
    assert got == sorted(brute(urls, rules), key=repr)
    plan = url_filters.judge(pages, spark.createDataFrame(rules, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_rows(spark):
    long = "http://" + "a." * 2000 + "com/" + "p/" * 500_000
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "x://"), (5, "x://COM"), (6, "x://com/"), (7, "x://.com/a"), (8, "x://com./a"), (9, "x://a..com/a\nb"), (None, "x://com/"), (6, "x://com/"), (10, long), (11, "://com/#/"), (12, "x://net\t/es/")]
    rules = [("com", "/", "block"), ("COM", "/", "allow"), (None, "/", "block"), ("com", None, "block"), ("com", "/a", None), ("com", "/a", "maybe"), ("", "/b", "block")]
    pages = spark.createDataFrame([(*u, "x", "y") for u in urls], "page_id long, url string, host string, verdict string")
    assert rows(url_filters.judge(pages, spark.createDataFrame(rules, RULES))) == sorted(brute(urls, rules), key=repr)
    none = spark.createDataFrame([], RULES)
    assert {r.verdict for r in url_filters.judge(pages, none, default="block").collect()} == {"block"}
    assert url_filters.judge(pages.limit(0), spark.createDataFrame(rules, RULES)).count() == 0
