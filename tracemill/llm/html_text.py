"""Main-text extraction with site template removal.

Pages are parsed into element trees; subtrees that may be furniture are hashed and counted per host in Spark, over pages with
different main texts (so that copies of one page make nothing a template), and subtrees that recur on many pages of their host
are deleted before the text is taken. For boxes, which hold half of their page's text at most, the number of such pages alone
decides, so that each of a host's layouts has its own; what may be running text (an inline element, a cell, a list) or the greater
part of a page must be on a share of the host's pages as well. Elements that are furniture by their own name, role or class go as well. Text blocks
of an article (paragraphs, headings, lists, tables) are never treated as templates, however often they recur.

Defined results: null or empty html, and pages of furniture alone, give an empty text; pages without a host in their url take
no part in counting; repeated rows each get their row; broken markup is read as far as it goes, at any depth of nesting.
"""

from __future__ import annotations

import functools
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, slices, table

#: A subtree is a template of its host if it is on so many different pages at least; if it is no box, on this share of them as well.
MIN_PAGES, MIN_SHARE = 5, 0.5

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE = re.compile("[>\"']")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:false|until))|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends, if one of these is open below the nearest of the barriers.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: End tags that do not reach beyond a barrier.
_WITHIN, _BARRIERS = frozenset("p li b i a span".split()), ("article", "main", "td", "th", "table")
_ENDS_P = _BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "figcaption"}
_FURNITURE = frozenset("head nav footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu title audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id names that mark furniture.
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert disclaimer sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist respond replies reply disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay paywall search widget widgets pagination pager skip toc".split())
_SAFE = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table tbody thead tfoot tr td th figure figcaption caption b i em strong a span code q cite small sub sup u s mark time abbr br img".split())


class Node:
    __slots__ = ("tag", "marks", "kids", "hash", "root", "chars")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.kids, self.hash, self.root, self.chars = tag, marks, [], 0, tag in ("article", "main"), 0


def _close(node: Node, digest) -> None:
    """Hash a finished element from its name and its children; note whether it holds an article."""
    parts = [node.tag]
    for kid in node.kids:
        if isinstance(kid, str):
            if text := " ".join(kid.split()):
                parts.append(text)
                node.chars += len(text)
        else:
            parts.append(f"<{kid.hash}>")
            node.root |= kid.root
            node.chars += kid.chars
    node.hash = digest("\x00".join(parts).encode("utf-8", "replace"))


class Tags:
    """The tags of a page in order, in time linear in its length whatever is broken.

    A tag ends at the first ``>`` outside quotes; where its quotes do not close before the page ends, at the first ``>``; without any it is text. From one opening quote on there is one way to go on, so a way
    that has led to the page's end is remembered and not walked again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.dead = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """Where the tag whose name ends before ``at`` ends; a ``>`` is known to follow."""
        way, i = [], at
        while m := _QUOTE.search(self.page, i):
            k = m.start()
            if self.page[k] == ">":
                return k
            if k in self.dead:
                break
            way.append(k)
            i = self.page.find(self.page[k], k + 1) + 1
            if not i:
                break
        self.dead.update(way)
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag or comment from ``at`` on; comments and declarations have no name."""
        while m := _OPEN.search(self.page, at):
            if m[1]:
                close = self.page.find("-->", m.end())
                return m.start(), close + 3 if close >= 0 else len(self.page), "", "", ""
            if m.start() > self.last:
                rest = self.page.find("<!--", m.start())  # an open comment hides the rest of the page even where no tag can end
                return (rest, len(self.page), "", "", "") if rest >= 0 else None
            at = m.end()
            close = self.page.find(">", at)
            if close < 0:
                continue
            if m[2]:
                return m.start(), close + 1, "", "", ""
            attrs = self.page[at:close]
            if "'" in attrs or attrs.count('"') % 2:  # else all quotes before the first > are closed
                close = self.end(at)
                attrs = self.page[at:close]
            return m.start(), close + 1, m[3], m[4].lower(), attrs
        return None


class Open:
    """The open elements, and for each tag where its open elements stand."""

    def __init__(self, top: Node, digest):
        self.stack, self.digest, self.places, self.blocks = [top], digest, {}, []

    def nearest(self, tags) -> int:
        """The innermost place of one of ``tags``; 0 without any."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(node.tag)
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            if self.stack:
                self.places[node.tag].pop()
                if node.tag in _BLOCK:
                    self.blocks.pop()
            _close(node, self.digest)


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile("</" + re.escape(tag), re.I | re.A)


def parse(page: str) -> Node:
    import xxhash

    def digest(data: bytes) -> int:
        return xxhash.xxh64_intdigest(data) - (1 << 63)

    top = Node("#")
    tags, open_, at = Tags(page), Open(top, digest), 0
    while True:
        found = tags.next(at)
        start = found[0] if found else len(page)
        if start > at:
            open_.stack[-1].kids.append(entities.unescape(page[at:start]))
        if not found:
            break
        _, at, slash, tag, attrs = found
        if not tag:
            continue
        if slash:
            places = open_.places.get(tag)
            here = places[-1] if places else 0
            if here and (tag not in _WITHIN or here > open_.nearest(_BARRIERS)):
                open_.cut(here)
            continue
        if tag in _ENDS_P:
            if open_.blocks and open_.blocks[-1] == "p":
                open_.cut(open_.nearest(("p",)))
        elif tag in _ENDS:
            ends, barrier = _ENDS[tag]
            if (here := open_.nearest(ends)) > open_.nearest(barrier):
                open_.cut(here)
        marks = " ".join(x[2] or x[3] or x[4] or "" for x in _MARK.finditer(attrs)).lower() if attrs else ""
        node = Node(tag, marks + (" #hidden" if attrs and _HIDDEN.search(attrs) else ""))
        open_.stack[-1].kids.append(node)
        if tag in _VOID:
            _close(node, digest)
        elif tag in _RAW:  # no markup inside
            m = _raw_end(tag).search(page, at)
            gt = page.find(">", m.start()) if m else -1
            at = gt + 1 if gt >= 0 else len(page)
            _close(node, digest)
        elif not attrs.endswith("/") or tag not in ("path", "rect", "circle", "use", "line", "g"):
            open_.push(node)
    open_.cut(0)
    return top


def furniture(node: Node, inside: bool) -> bool:
    """Is this element no part of an article, by its own name, role or class? ``inside``: it stands in an article."""
    if node.tag in _FURNITURE:
        return True
    if node.tag == "header":
        return not inside and not node.root
    if "#hidden" in node.marks:
        return not node.root
    if node.marks and not node.root and node.tag not in _SAFE:
        names = set(_SPLIT.split(node.marks))
        if inside:
            names -= {"header", "toc"}
        return bool(names & _WORDS) or bool(_ROLES & set(node.marks.split()))
    if node.marks and node.tag in ("article", "p"):  # comments are often marked up as articles of their own
        return bool({"comment", "comments", "reply", "advert", "ad", "sponsored"} & set(_SPLIT.split(node.marks)))
    return False


def roots(top: Node) -> list[Node]:
    """The outermost articles; without any, the outermost main elements; without these, the page."""
    for tag in ("article", "main"):
        found, stack = [], [top]
        while stack:
            node = stack.pop()
            if node.tag == tag and not furniture(node, False):
                found.append(node)
            elif node.tag == "#" or not furniture(node, False):
                stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
        if found:
            return found
    return [top]


def blocks(found: list[Node], templates: frozenset[int] | set[int]) -> list[str]:
    """Text blocks in page order; white space inside a block is one space."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for root in found:
        inside = root.tag != "#"
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif x is not root and (furniture(x, inside) or x.hash in templates and x.tag not in _SAFE):
                if x.tag in _BLOCK:
                    flush()
            else:
                if x.tag == "br":
                    run.append(" ")
                if x.tag in _BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.kids)
        flush()
    return out


def candidates(found: list[Node]) -> tuple[list[int], list[bool], int]:
    """Hashes of the subtrees that may be templates, which of them are boxes, and a mark of the page's text outside named furniture, which copies share."""
    import xxhash

    hashes, whole, mark = {}, sum(root.chars for root in found), xxhash.xxh64_intdigest("\n".join(blocks(found, set())).encode("utf-8", "replace")) - (1 << 63)
    for root in found:
        inside = root.tag != "#"
        stack = [root]
        while stack:
            x = stack.pop()
            if x is not root:
                if furniture(x, inside):
                    continue
                if x.chars and x.tag not in _SAFE and not (inside and x.tag in _TEXT_BLOCKS) and not x.root:
                    hashes[x.hash] = hashes.get(x.hash, True) and x.tag not in _TEXT_BLOCKS and 2 * x.chars <= whole
            stack += [k for k in x.kids if not isinstance(k, str)]
    return list(hashes), list(hashes.values()), mark


def extract(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars. Templates are joined back by page; the join is a broadcast only where Spark sees that it is small."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("page", F.xxhash64("url", "html"))

    def gather(batches):
        for batch in slices(batches, "html"):
            got = [candidates(roots(parse(x or ""))) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page": batch.column("page"), "host": batch.column("host"), "hashes": pa.array([g[0] for g in got], pa.list_(pa.int64())), "boxes": pa.array([g[1] for g in got], pa.list_(pa.bool_())), "mark": pa.array([g[2] for g in got], pa.int64())})

    seen = src.where((host != "") & host.isNotNull()).select("page", host.alias("host"), "html").mapInArrow(gather, "page long, host string, hashes array<bigint>, boxes array<boolean>, mark long")
    seen = keep(seen.where(F.size("hashes") > 0), "page-trees")
    each = seen.select("page", "host", "mark", F.explode(F.arrays_zip("hashes", "boxes")).alias("x")).select("page", "host", "mark", F.col("x.hashes").alias("hash"), F.col("x.boxes").alias("box"))
    recurring = each.groupBy("host", "hash", "mark").agg(F.min("box").alias("box")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.min("box").alias("box")).where(F.col("n") >= min_pages)
    per_host = seen.groupBy("host", "mark").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
    templates = recurring.join(per_host, "host").where(F.col("box") | (F.col("n") >= min_share * F.col("of"))).select("host", "hash")
    drops = keep(each.select("page", "host", "hash").distinct().join(templates, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("templates")), "page-templates")

    def run(batches):
        for batch in slices(batches, "html"):
            texts = ["\n".join(blocks(roots(parse(x or "")), set(t or ()))) for x, t in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.join(drops, "page", "left").select("page_id", "url", "html", "templates").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
