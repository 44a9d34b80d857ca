"""Main text of pages by differencing pages of like URL, and markup.

Pages of a host are put in URL order (path, query, lines); pages of equal
lines next to each other are one run, and each page is paired with the page
before or after its run whose URL shares more with its own. The text lines of the two are
aligned by longest common subsequence, and shared lines go: they belong to
the site. Differencing alone leaves menus that change from page to page and
would take sentences that two articles share, so markup has a say first:
lines inside an explicit ``article`` (or main) element stay, lines inside
menus, headers, footers, sidebars, notices and forms (by element or role) and
comments (also by class or id) go, and differencing decides on all others,
among them parts of a page or article that a class or id alone marks as the
site's (an article or main part inside such a part stays). Of these others,
lines that are links only also go.

Scale: line hashes, not texts, are sorted and paired. The order is a range
exchange over (host, path, query, hash of lines), so a host or a path with a
third of all pages spreads over many tasks; runs are numbered from one row per
range, and meet the runs next to them by number.

Defined cases: null or empty html gives an empty text; a page with a null or
unreadable url, or alone on its host, or whose host has only copies of it,
loses no line by differencing; repeated rows are extracted once each; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypoint.llm.common import others, table
from waypoint.session import materialize

#: Zones of a line; HEADER, MAIN_HEADER: in an article's or main part's own header; MARKED, MARKED_PART,
#: MARKED_HEADER: a class or id marks it as the site's, outside an article, in one, and as one's header.
KEEP, OPEN, DROP, HEADER, MAIN_HEADER, MARKED, MARKED_PART, MARKED_HEADER = range(8)

#: Tags, comments and declarations; attribute values in quotes (after ``=`` only) may hold ``>``.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is never text of the page; PLAIN: not even markup, and to the end if they are not closed.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "canvas",
       "audio", "video", "select", "noframes", "xmp"}
PLAIN = {"script", "style", "title", "textarea"}
#: Elements of a head; any other ends it.
HEAD_PARTS = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SITE_ELEMENTS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "head"}
SITE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog",
              "form", "menu", "menubar", "toolbar", "note"}
#: Words of a class or id that mark a part of the site.
SITE_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar",
              "footer", "sidebar", "aside", "widget", "ad", "ads", "advert", "adverts", "advertisement", "sponsor",
              "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup",
              "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share",
              "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "respond", "replies",
              "pagination", "pager", "toolbar", "skip", "alert", "toast", "copyright", "disclaimer", "announcement",
              "popular", "trending", "recommendations", "promotion", "advertising", "teaser"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
#: Words that say a name is not of the part it names: "has-sidebar", "comments-open", "content-sidebar-wrap".
STATES, WRAPS = {"has", "no", "with", "without", "open", "closed"}, {"wrap", "wrapper"}
#: Zone of headings in a zone where they differ from other lines.
HEADING_ZONES = {HEADER: KEEP, MARKED_HEADER: KEEP, MAIN_HEADER: OPEN}


#: Elements that close their like, and where that ends.
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"})}


class Stack(list):
    """Open elements (tag, zone, link, main), with how many of each tag are open: nothing is sought in vain."""

    def __init__(self):
        super().__init__([("", OPEN, False, False)])
        self.open: Counter = Counter()

    def push(self, element: tuple) -> None:
        self.append(element)
        self.open[element[0]] += 1

    def close(self, names: set[str], stops: set[str] = frozenset()) -> None:
        """Closes the innermost of ``names`` with all in it, unless one of ``stops`` is further in."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self) - 1, 0, -1):
            if self[i][0] in names:
                for element in self[i:]:
                    self.open[element[0]] -= 1
                del self[i:]
                return
            if self[i][0] in stops:
                return


def _raw_end(page: str, tag: str, at: int, ends: dict[str, int]) -> int | None:
    """Where the content of an element that begins at ``at`` ends, or None if it is not closed.

    Elements that may hold their like end with the end tag that balances them, or else with the last one."""
    if tag not in ends:
        ends[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\s*>", page, re.I)), default=-1)
    if ends[tag] < at:
        return len(page) if tag in PLAIN else None
    depth, end = 1, at
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        if m[1]:
            depth, end = depth - 1, m.end()
            if not depth or tag in PLAIN:
                break
        elif not m[0].endswith("/>"):
            depth += 1
    return end


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): _html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(text)}


def _is_main(tag: str, attrs: dict[str, str]) -> bool:
    return (tag == "main" or attrs.get("role", "").lower() == "main"
            or attrs.get("itemprop", "").lower() == "articlebody")


def _zone(tag: str, attrs: dict[str, str], parent: int, main: bool) -> int | None:
    """The zone an element opens below ``parent`` (and in a main part), or None where it takes its parent's."""
    tokens = [{w.lower() for w in NAME_PART.findall(t)} for a in ("class", "id") for t in attrs.get(a, "").split()]
    names = [t for t in tokens if not t & STATES]
    comments = any(t & COMMENT_WORDS for t in names)
    if attrs and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
                  or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I)):
        return DROP
    if tag == "article":
        return DROP if comments else KEEP
    if tag in ("html", "body"):
        return None
    if _is_main(tag, attrs):  # a main part keeps its lines only where there is no article: see lines()
        return OPEN if parent == MARKED else None
    if tag == "header":
        return HEADER if parent == KEEP else MAIN_HEADER if main and parent in (OPEN, MARKED) else DROP
    if comments or tag in SITE_ELEMENTS or attrs.get("role", "").lower() in SITE_ROLES:
        return DROP
    if any(t & SITE_WORDS for t in names if not t & WRAPS):
        if parent == KEEP:
            return MARKED_HEADER if any("header" in t for t in names) else MARKED_PART
        return MARKED if parent == OPEN else None
    return None


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, zone, links only) of the page's blocks, in order; white space is one space."""
    out: list[tuple[str, int, bool, bool]] = []
    stack, ends = Stack(), {}
    buffer: list[str] = []
    linked = [0, 0]  # characters outside and inside links
    at, articles = 0, False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                _, zone, _, main = stack[-1]
                out.append((text, zone, linked[1] > 0 and linked[0] == 0, main))
            buffer.clear()
        linked[0] = linked[1] = 0

    def text_of(s: str) -> None:
        if s:
            s = _html.unescape(s) if "&" in s else s
            if stack[-1][0] == "head" and not s.isspace():
                stack.close({"head"})
            buffer.append(s)
            if not s.isspace():
                linked[stack[-1][2]] += 1

    for m in MARKUP.finditer(page):
        start, end = m.span()
        if start < at:
            continue
        tag = (m[2] or m[5] or "").lower()
        closing = (m[1] or m[4]) == "/"
        text_of(page[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if closing:
            stack.close({tag})
            continue
        if tag == "body" or stack[-1][0] == "head" and tag not in HEAD_PARTS:
            stack.close({"head"})
        if tag in RAW:
            empty = (m[3] or m[6] or "").endswith("/") and tag not in PLAIN
            at = end if empty else _raw_end(page, tag, end, ends) or end
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:  # closes an open paragraph, and the item before it
            stack.close({"p"}, BLOCK - {"p"})
            if tag in ITEMS:
                stack.close(*ITEMS[tag])
        attrs = _attributes(m[3] or m[6] or "")
        _, zone, link, main = stack[-1]
        if zone != DROP:
            opened = _zone(tag, attrs, zone, main)
            if tag in HEADINGS and opened != DROP:
                opened = HEADING_ZONES.get(zone, opened)  # an article's own header: its headings stay
            zone = zone if opened is None else opened
            articles |= zone == KEEP and tag == "article"
        main |= _is_main(tag, attrs)
        stack.push((tag, zone, link or tag == "a", main))
    text_of(page[at:])
    flush()
    mains = any(x[3] for x in out)
    return [(text, _settled(zone, main, articles, mains), only) for text, zone, only, main in out]


def _settled(zone: int, main: bool, articles: bool, mains: bool) -> int:
    """Without an article, a main part is kept; beside an article or main part, only main's other lines are open."""
    if zone in (MARKED_PART, MARKED_HEADER):
        return OPEN
    if zone not in (OPEN, MARKED):
        return min(zone, DROP)
    if zone == OPEN and not articles and main:
        return KEEP
    return DROP if (articles or mains) and not main else OPEN


#: Bits that an alignment's table may hold before the texts are halved.
TABLE_BITS = 1 << 27


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the alignment table: a zero in bit i of row j adds a line to the common subsequence."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    out = [v]
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of every prefix of ``a`` with ``b``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8)
    zeros = 1 - np.unpackbits(bits, bitorder="little")[:len(a)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head:len(a) - tail]) & set(b[head:len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in both]
    x, y = [a[i] for i in at], [v for v in b[head:len(b) - tail] if v in both]
    inner = [at[i] for i in _aligned(x, y)]
    return [*range(head), *inner, *range(len(a) - tail, len(a))]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(b) > 1:
        mid = len(b) // 2
        first, second = _lengths(a, b[:mid]), _lengths(a[::-1], b[:mid - 1:-1])[::-1]
        cut = int(np.argmax(first + second))
        return _aligned(a[:cut], b[:mid]) + [cut + i for i in _aligned(a[cut:], b[mid:])]
    rows, i, j, out = _rows(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif rows[j] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _place(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, path and query of a url (None of each where it has no host)."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return None, None, None
    return (parts.netloc.lower(), parts.path, parts.query) if parts.netloc else (None, None, None)


def _near(a: tuple[str, str], b: tuple[str, str]) -> tuple[int, int, int]:
    """How much two (path, query) share: leading segments, then leading characters, then those of the query."""
    def common(x, y) -> int:
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    return common(a[0].split("/"), b[0].split("/")), common(a[0], b[0]), common(a[1], b[1])


def hashed(pages: DataFrame) -> DataFrame:
    """(key, host, path, query, lines, open): line hashes of every page, and the positions of lines
    that differencing may delete. ``key`` is a hash of the page's id, url and html."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, url, page in zip(b["key"], b["url"], b["html"]):
                found = lines(page or "")
                rows.append((key, *_place(url), [xxhash.xxh64_intdigest(x[0].encode("utf-8", "surrogatepass")) - (1 << 63) for x in found],
                             [i for i, x in enumerate(found) if x[1] == OPEN]))
            yield pd.DataFrame(rows, columns=["key", "host", "path", "query", "lines", "open"])

    return pages.select("key", "url", "html").mapInPandas(
        run, "key long, host string, path string, query string, lines array<long>, open array<int>")


PLACE = ("host", "path", "query", "same")


def runs(places: DataFrame) -> DataFrame:
    """``places`` (PLACE, lines; a row for each PLACE) with ``run``: the number of its run. Rows next to
    each other in PLACE order are of one run where host and ``same`` are equal; runs are numbered in order."""
    ranged = materialize(places.repartitionByRange(*PLACE).select(
        F.spark_partition_id().alias("part"), *PLACE, "lines"), "url-order")
    order = Window.partitionBy("part").orderBy(*PLACE)
    kind = F.struct("host", "same")
    first = F.lag(F.lit(True)).over(order).isNull()
    starts = F.when(first, 0).otherwise((F.lag(kind).over(order) != kind).cast("long"))
    marked = ranged.select("part", *PLACE, "lines", starts.alias("new"))
    ends = (marked.groupBy("part").agg(F.min(F.struct(*PLACE)).alias("lo"), F.max(F.struct(*PLACE)).alias("hi"),
                                       F.sum("new").alias("k")))
    parts = Window.orderBy("part")  # a row for each range
    prior = F.lag("hi").over(parts)
    ends = ends.select("part", "k", F.when((prior["host"] == F.col("lo.host")) & (prior["same"] == F.col("lo.same")), 0)
                       .otherwise(1).alias("new"))
    ends = ends.select(F.col("part").alias("of"), (F.sum(F.col("k") + F.col("new")).over(parts) - F.col("k")).alias("base"))
    return (marked.join(F.broadcast(ends), F.col("part") == F.col("of"))
            .select(*PLACE, "lines", (F.col("base") + F.sum("new").over(order)).alias("run")))


def neighbours(numbered: DataFrame) -> DataFrame:
    """(run, before, after): the rows (host, path, query, lines) next to each run of ``numbered`` (see ``runs``)."""
    url = F.struct("host", "path", "query")
    nodes = materialize(numbered.groupBy("run").agg(F.min(url).alias("lo"), F.max(url).alias("hi"),
                                                    F.first("lines").alias("lines")), "url-runs")
    before = nodes.select((F.col("run") + 1).alias("run"), F.struct("hi.*", "lines").alias("before"))
    after = nodes.select((F.col("run") - 1).alias("run"), F.struct("lo.*", "lines").alias("after"))
    return nodes.select("run").join(before, "run", "left").join(after, "run", "left")


def deletions(pages: DataFrame) -> DataFrame:
    """(key, gone): positions of the lines that the page shares with the page of the nearest URL."""
    each = materialize(hashed(pages).withColumn("same", F.xxhash64("lines")), "page-lines")
    placed = each.where("host IS NOT NULL")
    places = placed.groupBy(*PLACE).agg(F.first("lines").alias("lines"))
    numbered = materialize(runs(places), "url-numbers")
    around = numbered.select(*PLACE, "run").join(neighbours(numbered), "run").drop("run")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                best = None
                for n in (r.before, r.after):
                    if n is not None and n["host"] == r.host:
                        near = _near((r.path, r.query), (n["path"], n["query"]))
                        if best is None or near > best[0]:
                            best = near, list(n["lines"])
                if best:
                    may = set(r.open)
                    gone = [i for i in shared_lines(list(r.lines), best[1]) if i in may]
                    if gone:
                        out.append((r.key, gone))
            yield pd.DataFrame(out, columns=["key", "gone"])

    met = placed.join(around, list(PLACE))
    return (met.select("key", "host", "path", "query", "lines", "open", "before", "after")
            .mapInPandas(run, "key long, gone array<int>").dropDuplicates(["key"]))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) without html, with ``text``: the main text of every page."""
    passed = others(pages, "html", "text")
    keyed = pages.select(*passed, "html", F.xxhash64("page_id", "url", "html").alias("__key"))
    gone = materialize(deletions(keyed.select(F.col("__key").alias("key"), "url", "html")), "shared-lines")

    def run(page: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for p, g in zip(page, gone):
            drop = set() if g is None else set(g)
            out.append("\n".join(text for i, (text, zone, only) in enumerate(lines(p))
                                 if zone == KEEP or zone == OPEN and not only and i not in drop))
        return pd.Series(out)

    gone = gone.select(F.col("key").alias("__of"), F.col("gone").alias("__gone"))
    return (keyed.join(gone, F.col("__key") == F.col("__of"), "left")
            .select(*passed, F.pandas_udf(run, "string")(F.coalesce("html", F.lit("")), "__gone").alias("text")))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
