"""Main text of a page by tag-path ratios.

A page becomes a sequence of text nodes, each with its root-to-leaf tag path. Parts that are menus, site
headers, footers, sidebars, notices, adverts, forms or comments by tag, role or a word of a class name go first.
For each path the lengths of its texts and their punctuation marks are added up and divided by its number
of nodes; links count against a path. Both ratios are smoothed over the nodes in page order, fused by their
product, and paths over a threshold are content.

Where article elements hold content, those of the parent with most of it are the article, else a main
element is, with all its blocks but those of links that no content path has. Elsewhere it is the smallest element that holds all content nodes, and in it the blocks with
a content path, headings, and those between content blocks that aren't links for the most part.

Time and memory are in proportion to the page, whatever its markup: elements carry what they inherit, a
path is its parent's number and a label, and each open element is closed once.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import read_table

START = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|[!?])")
#: The rest of a tag, in which quoted values may hold a `>`; it never goes back.
REST = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Elements whose content is no markup.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag of a kind closes, and those beyond which it doesn't look.
CLOSES = (
    (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    (frozenset(("dt", "dd")), frozenset(("dl",))),
    (frozenset(("tr",)), frozenset(("table",))),
    (frozenset(("td", "th")), frozenset(("tr", "table"))),
    (frozenset(("option",)), frozenset(("select",))),
)
SCOPED = frozenset(t for closed, limit in CLOSES for t in closed | limit)
ARTICLE = frozenset(("article", "main"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Never text of an article, by tag, and by role.
DROPPED = frozenset("script style noscript template head title nav aside footer button select option input textarea iframe object svg canvas dialog menu audio video map".split())
DROPPED_ROLE = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"))
#: The same by class or id: names that hold one of these words beside any others,
KINDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe signup "
    "comment comments commentlist disqus respond reply replies sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead header toolbar login".split()
)
#: unless one of these turns its meaning: layouts that go without or with such parts, and phrases about something.
TURNED = frozenset("has have with without no not non on of about for in and or to vs is work study theory analysis history".split())
#: Words for parts that an article has too: in an article, and beside its own words, they are its own.
SHARED = frozenset("header banner notice notices alert alerts promo promotion widget widgets".split())
OWN = frozenset("article post entry story content body text title section chapter".split())
#: Elements that a form for input doesn't hold; one that does is the layout of the page.
LAYOUT = frozenset("article main nav header footer h1".split())
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？…、]")
#: Weights in smoothing, the share of the standard deviation that is the threshold, and of the text above which a form is layout.
KERNEL, LAMBDA, ALL = (0.25, 0.5, 0.25), 0.5, 0.9


class _Element:
    __slots__ = ("tag", "parent", "number", "path", "flow", "dropped", "link", "article", "main", "form", "block", "scope")


class _Page:
    """Elements of a page in order and its text nodes (element, run, text); texts of one run are one block."""

    def __init__(self, page: str):
        self.elements: list[_Element] = []
        self.nodes: list[tuple[_Element, int, str]] = []
        self.layout: set[int] = set()
        self.paths: dict[tuple[int, str], int] = {}
        self.opened: Counter = Counter()  # open blocks by tag, other open elements by block and tag
        self.run = 0
        self.top = self._element("", None, {})
        self._read(page)

    def _element(self, tag: str, up: _Element | None, a: dict[str, str]) -> _Element:
        e = _Element()
        e.tag, e.parent, e.number = tag, up, len(self.elements)
        self.elements.append(e)
        if up is None:
            e.path, e.flow, e.dropped, e.link, e.article, e.main, e.form, e.block, e.scope = 0, 0, False, False, None, None, None, e, (None,) * len(CLOSES)
            return e
        name = f"{a.get('class') or ''} {a.get('id') or ''}".split()
        label = f"{tag}.{name[0].lower()}" if name and tag in ("div", "section", "td", "span", "ul", "table") else tag
        e.path = self.paths.setdefault((up.path, label), len(self.paths) + 1)
        # A link's text counts against the path of the text that it stands in.
        e.flow = up.flow if up.link else up.path if tag == "a" else e.path
        e.link, e.block = up.link or tag == "a", e if tag in BLOCK else up.block
        e.main = up.main if up.main is not None else e if tag == "main" else None
        e.article = up.article if up.article is not None else e if tag == "article" else None
        e.form = up.form if up.form is not None else e if tag == "form" else None
        if e.form is not None and tag in LAYOUT:
            self.layout.add(e.form.number)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "")
        e.dropped = up.dropped or tag in DROPPED or hidden or a.get("role") in DROPPED_ROLE or tag == "header" and e.article is None and e.main is None
        if name and not e.dropped and tag not in ARTICLE and tag not in ("html", "body"):
            e.dropped = any(_furniture(x, e.article is not None or e.main is not None) for x in name)
        e.scope = up.scope
        if tag in SCOPED:
            e.scope = tuple(e if tag in closed else None if tag in limit else s for (closed, limit), s in zip(CLOSES, up.scope))
        return e

    def _key(self, e: _Element):
        return e.tag if e.block is e else (e.block.number, e.tag)

    def _close(self, e: _Element) -> None:
        """Close e and all that is open in it."""
        while True:
            top = self.top
            self.opened[self._key(top)] -= 1
            self.top = top.parent
            if top is e:
                return

    def _end(self, tag: str) -> None:
        """An end tag closes up to its element, if that is open; what isn't a block only inside its block."""
        if self.opened[tag if tag in BLOCK else (self.top.block.number, tag)]:
            e = self.top
            while e.tag != tag:
                e = e.parent
            self._close(e)

    def _begin(self, tag: str) -> None:
        """A block ends a paragraph that is open, a heading another one, a list item the one before."""
        block = self.top.block
        if block.tag == "p" or block.tag in HEADING and tag in HEADING:
            self._close(block)
        for i, (closed, _) in enumerate(CLOSES):
            if tag in closed and self.top.scope[i] is not None:
                self._close(self.top.scope[i])

    def _read(self, page: str) -> None:
        at, n, quotes = 0, len(page), True
        while at < n:
            m = START.search(page, at)
            if raw := page[at : m.start()] if m else page[at:]:
                self.nodes.append((self.top, self.run, raw))
            if not m:
                return
            if not m[2]:
                at = self._declaration(page, m.start())
                continue
            end = m.end()
            if quotes:
                end = REST.match(page, m.end()).end()
                quotes = end < n and page[end] == ">"
            if not quotes:  # a quote isn't closed: from here on they don't count
                end = page.find(">", m.end())
                if end < 0:
                    self.nodes.append((self.top, self.run, page[m.start() :]))
                    return
            at = self._tag(page, m[2].lower(), bool(m[1]), page[m.end() : end], end + 1)

    def _declaration(self, page: str, at: int) -> int:
        for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
            if page.startswith(start, at):
                end = page.find(stop, at + len(start))
                if start == "<![CDATA[":
                    self.nodes.append((self.top, self.run, page[at + len(start) : end if end >= 0 else len(page)].replace("&", "&amp;")))
                return end + len(stop) if end >= 0 else len(page)

    def _tag(self, page: str, tag: str, ends: bool, rest: str, at: int) -> int:
        if tag == "br":
            self.nodes.append((self.top, self.run, " "))
        if tag in BLOCK:
            self.run += 1
        if ends:
            self._end(tag)
            return at
        if tag in BLOCK:
            self._begin(tag)
        if tag in VOID:
            return at
        a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(rest)} if rest.strip(" /\n\t") else {}
        e = self._element(tag, self.top, a)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            return page.find(">", end.start()) + 1 or len(page) if end else len(page)
        if rest.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            return at
        self.top = e
        self.opened[self._key(e)] += 1
        return at


def _furniture(name: str, in_article: bool) -> bool:
    words = re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().strip("-_"))
    kinds = KINDS.intersection(words)
    if not kinds or not TURNED.isdisjoint(words):
        return False
    return not (kinds <= SHARED and (in_article or not OWN.isdisjoint(words)))


def _smooth(x: list[float]) -> list[float]:
    a, b, c = KERNEL
    return [a * x[max(0, i - 1)] + b * x[i] + c * x[min(len(x) - 1, i + 1)] for i in range(len(x))]


def content_paths(nodes: list[tuple[int, str, bool]]) -> set[int]:
    """Paths of content among nodes of (path, text, in a link); links have the path of the text around them."""
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for path, text, link in nodes:
        n = len(text)
        length[path] += -n if link else n
        marks[path] += 0 if link else len(PUNCTUATION.findall(text))
        count[path] += 1
    ratio = {p: max(0.0, length[p]) / count[p] for p in count}
    dots = {p: marks[p] / count[p] for p in count}
    s1, s2 = _smooth([ratio[p] for p, _, _ in nodes]), _smooth([dots[p] for p, _, _ in nodes])
    fused: dict[int, float] = defaultdict(float)
    for (p, _, _), a, b in zip(nodes, s1, s2):
        fused[p] = max(fused[p], math.sqrt(a * (b + 0.1)) if ratio[p] else 0.0)
    values = [fused[p] for p, _, _ in nodes]
    mean = sum(values) / len(values)
    threshold = LAMBDA * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return {p for p, v in fused.items() if v > 0 and v >= min(threshold, mean)}


def _without_forms(page: _Page, nodes: list) -> list:
    """nodes without those in forms for input; a form around the page's layout or nearly all its text is none."""
    size, total = Counter(), 0
    for e, _, _, clean in nodes:
        total += len(clean)
        if e.form is not None:
            size[e.form.number] += len(clean)
    input_ = {f for f, n in size.items() if f not in page.layout and n < ALL * total}
    return [x for x in nodes if x[0].form is None or x[0].form.number not in input_]


def _smallest(page: _Page, numbers: list[int]) -> tuple[int, int]:
    """First and last number of the elements in the smallest element that holds all of numbers."""
    last = list(range(len(page.elements)))
    for e in reversed(page.elements[1:]):
        last[e.parent.number] = max(last[e.parent.number], last[e.number])
    e, end = page.elements[min(numbers)], max(numbers)
    while last[e.number] < end or e.block is not e:
        e = e.parent
    return e.number, last[e.number]


def _article(content: list) -> set[int]:
    """The article elements that are the article, or the main element; none if content is in neither.

    Article elements with one parent belong together: comments and teasers have another than the article. Of
    such groups the one with most text on content paths counts, the first of equals.
    """
    groups: dict[tuple, int] = {}
    for e, n in content:
        if (x := e.article) is not None:
            groups[True, x.parent.number] = groups.get((True, x.parent.number), 0) + n
        elif (x := e.main) is not None:
            groups[False, x.number] = groups.get((False, x.number), 0) + n
    if not groups:
        return set()
    with_articles = {g: n for g, n in groups.items() if g[0]} or groups
    (articles, number) = max(with_articles, key=with_articles.get)
    return {e.article.number for e, _ in content if e.article is not None and e.article.parent.number == number} if articles else {number}


def main_text(text: str | None) -> str:
    """The article's blocks, one on a line: references decoded, white space runs a single space, trimmed.

    Null, empty and textless pages give "". Broken markup is read as far as it goes; nothing is cut off.
    """
    if not text:
        return ""
    page = _Page(text)
    nodes = []
    for e, run, raw in page.nodes:
        if not e.dropped:
            raw = html.unescape(raw) if "&" in raw else raw
            nodes.append((e, run, raw, " ".join(raw.split())))
    nodes = _without_forms(page, nodes)
    solid = [x for x in nodes if x[3]]
    if not solid:
        return ""
    chosen = content_paths([(e.flow, clean, e.link) for e, _, _, clean in solid])
    if not any(e.path in chosen and not e.link for e, _, _, _ in solid):
        chosen = {e.path for e, _, _, _ in solid if not e.link}
    content = [(e, len(clean)) for e, _, _, clean in solid if e.path in chosen and not e.link]
    if not content:  # nothing but links
        return ""
    inside = _article(content)
    first, last = (0, 0) if inside else _smallest(page, [e.number for e, _ in content])

    blocks: dict[int, list] = {}
    for x in nodes:
        blocks.setdefault(x[1], []).append(x)
    kept, waiting = [], []  # blocks behind the last content block wait for another one
    for pieces in blocks.values():
        line = " ".join("".join(raw for _, _, raw, _ in pieces).split())
        if not line:
            continue
        if inside:
            here = any(x is not None and x.number in inside for e, _, _, clean in pieces if clean for x in (e.article, e.main))
            links = sum(len(clean) for e, _, _, clean in pieces if e.link)
            kept += [line] if here and (2 * links <= len(line) or any(e.path in chosen and not e.link for e, _, _, clean in pieces if clean)) else []
            continue
        if not any(first <= e.number <= last for e, _, _, clean in pieces if clean):
            continue
        links = sum(len(clean) for e, _, _, clean in pieces if e.link)
        if any(e.path in chosen and not e.link for e, _, _, clean in pieces if clean):
            kept += [*waiting, line]
            waiting = []
        elif 2 * links <= len(line) and (kept or any(e.block.tag in HEADING for e, _, _, _ in pieces)):
            waiting.append(line)
    return "\n".join(kept or waiting)


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col, the main text of each whole page; a column of that name is replaced.

    All other columns, html included, pass through; repeated rows get equal results.
    """
    kept = pages.drop(out_col)
    at = kept.columns.index(html_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                cut = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array([main_text(x) for x in cut.column(at).to_pylist()], pa.string())], [*b.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
