"""URL filters: rules of allow lists and block lists applied by a sort-merge range join.

A host with its labels reversed (``www.example.com`` is ``com.example.www.``) starts with the reversed host of each rule that fits it, so a
rule's hosts are one interval of the sorted keys, and intervals of rules either nest or are apart. Rules and urls are dealt over ranges
of these keys, a rule to each range that its interval meets, and sorted. A sweep over a range keeps the rules' hosts that enclose the
current key on a stack; the paths of one host are sorted, each linked to the longest other one that it starts with.

Ranges are cut at keys of a sample (``SAMPLED`` keys a range). The sample only balances tasks; a host with many pages is cut by a hash of
its urls. A task holds the rules of the hosts that enclose one key, and no others, at a time.

Defined results: a null url, or one without ``://``, has an empty host and path; only rules for the empty host fit it, and every other
url too. The longest rule (characters of host and path) wins, then the one with the longer host; of rules for one host and path a
``block`` wins. Rules with a null in them count for nothing; an empty rule table leaves every url to ``default``. Repeated rows each get
their row, whatever their key, and other columns of both tables are not read. A long url costs what its characters cost.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled for each range, and characters of a reversed host that count for the cuts between ranges.
SAMPLED, CUT = 50, 200
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def lower_az(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_az(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Paths:
    """The rules of one host, added in the order of their paths."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.outer: list[int] = []
        self.open: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            self.verdicts[-1] = max(self.verdicts[-1], verdict)
            return
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        self.outer.append(self.open[-1] if self.open else -1)
        self.open.append(len(self.paths))
        self.paths.append(path)
        self.verdicts.append(verdict)

    def find(self, path: str) -> int:
        """The longest path that ``path`` starts with: the last one not above it, or one that this is nested in; else -1."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return i


def _sweep(default: str):
    def run(batches):
        stack: list[Paths] = []
        current = None
        for batch in batches:
            out = []
            keys = batch.column("key")
            for i, (at, rev, path, host, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "rev", "path", "host", "verdict")), strict=True)):
                if at != current:
                    current = at
                    stack.clear()
                while stack and not rev.startswith(stack[-1].key):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1].key != rev:
                        stack.append(Paths(rev, host))
                    stack[-1].add(path, verdict)
                    continue
                best, rule, said = -1, None, default
                for hosts in stack:
                    j = hosts.find(path)
                    if j >= 0 and len(hosts.host) + len(hosts.paths[j]) >= best:
                        best, rule, said = len(hosts.host) + len(hosts.paths[j]), hosts.host + hosts.paths[j], hosts.verdicts[j]
                out.append((i, host, path, rule, said))
            at, hosts, paths, rules, verdicts = zip(*out, strict=True) if out else ([],) * 5
            texts = {n: pa.array(v, pa.string()) for n, v in (("host", hosts), ("path", paths), ("rule", rules), ("verdict", verdicts))}
            yield pa.RecordBatch.from_pydict({"key": keys.take(pa.array(at, pa.int64())), **texts})

    return run


def _dealt(cuts: list[tuple[str, int]], rules: bool):
    """Rows with their range: a url's own, a rule's all ranges that its interval meets."""
    low, high = -(1 << 63), 1 << 63

    def run(batches):
        for batch in batches:
            if rules:
                ends = [(bisect_right(cuts, (r[:CUT], low)), bisect_right(cuts, (r[:CUT] + chr(0x10FFFF), high))) for r in batch.column("rev").to_pylist()]
                take = [i for i, (a, b) in enumerate(ends) for _ in range(a, b + 1)]
                at = [k for a, b in ends for k in range(a, b + 1)]
                batch = batch.take(pa.array(take, pa.int64()))
            else:
                at = [bisect_right(cuts, (r[:CUT], s)) for r, s in zip(batch.column("rev").to_pylist(), batch.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "range"])

    return run


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", *, default: str = "allow") -> DataFrame:
    """``key``, host, path, rule (host and path of the rule that decided, else null), verdict of every row's ``url``.

    ``rules``: host, path, verdict (``allow`` or ``block``). A rule fits its host and all subdomains where the path starts with the rule's.
    """
    spark = pages.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).select("*", reversed_host(F.col("host")).alias("rev"), F.xxhash64("key", "path").alias("salt"))
    total = urls.count()
    one_in = max(1, total // (SAMPLED * n))
    sample = sorted(map(tuple, urls.where(F.pmod(F.xxhash64("salt", F.lit(7)), F.lit(one_in)) == 0).select(F.substring("rev", 1, CUT), "salt").collect())) if n > 1 else []
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    clean = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    ruled = clean.select(F.lit(None).cast(urls.schema["key"].dataType).alias("key"), lower_az(F.col("host")).alias("host"), "path", "verdict").select("key", "host", "path", reversed_host(F.col("host")).alias("rev"), F.lit(0).cast("long").alias("salt"), "verdict")
    urls = urls.withColumn("verdict", F.lit(None).cast("string"))
    kind = urls.schema["key"].dataType.simpleString()
    shape = f"key {kind}, host string, path string, rev string, salt bigint, verdict string, range int"
    rows = urls.mapInArrow(_dealt(cuts, False), shape).unionByName(ruled.mapInArrow(_dealt(cuts, True), shape))
    dealt = rows.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "rev", F.col("verdict").isNull(), "path")
    return dealt.mapInArrow(_sweep(default), f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
ORACLE = f"""WITH u AS (SELECT page_id, translate(regexp_extract({_REST}, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES {', '.join(map(str, RULES))}),
m AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS said FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT page_id, u.host, u.path, rule, coalesce(said, 'allow') AS verdict FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path"""
