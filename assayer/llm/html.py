"""Main text of web pages by tree scoring.

A page becomes a tree of elements and, in page order, its blocks of text. Each block passes points for its length and commas to
its ancestors, less the further away they are; an element's points are discounted by the share of its text inside links. The best
container and the siblings that resemble it are kept, without the parts that are furniture by their element, role or name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)

# Fixed lists of the markup language and of usual names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object select canvas audio video".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split()
)
FURNITURE = set("nav footer aside form button dialog menu search head label option".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar social share sharing related recommended recommendations popup modal overlay widget "
    "widgets pagination pager skip login signup register alert search".split()
)
COMMENTS = set("comment comments commentlist respond disqus reply replies discussion".split())
STATES = set("has no with open closed enabled disabled count".split())  # parts of names that say how a page is, not what an element is
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = HEADINGS | set("p blockquote pre".split())  # dropped for a name only if every part of it says so
CLOSED_BY_BLOCK = {"p"}
SIBLINGS_END = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SAME = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}

HALF_LIFE = 2.0  # an ancestor gets this much less with every level
SIBLING_SHARE = 0.2  # of the best container's points
MENU_DENSITY, MENU_LINKS = 0.8, 3  # a list of links


class Page:
    """The tree of one page: parallel lists by element, and blocks as (element, text, characters in links, links)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.furniture, self.soft = ["#root"], [-1], [False], [False]
        self.blocks: list[tuple[int, str, int, int]] = []
        self._stack, self._text, self._linked, self._links, self._anchor = [0], [], [], 0, 0
        at = 0
        while at < len(html):
            m = TOKEN.search(html, at)
            if m is None:
                self._add(html[at:])
                break
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["close"]:
                self._end(name)
            elif name in RAW and not m["attributes"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            else:
                self._start(name, m["attributes"])
        self._flush()

    def _add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._anchor:
            self._linked.append(text)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._stack[-1], text, len(" ".join("".join(self._linked).split())), self._links))
        self._text, self._linked, self._links = [], [], 0

    def _pop(self) -> None:
        self._flush()
        self._stack.pop()

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name == "a":
            self._anchor, self._links = 1, self._links + 1
            return
        if name not in BLOCKS and name not in FURNITURE:
            return
        self._flush()
        if name in BLOCKS:
            while self.tag[self._stack[-1]] in CLOSED_BY_BLOCK:
                self._pop()
        if name in SIBLINGS_END:
            for depth in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[depth]]
                if tag in SIBLINGS_END[name]:
                    break
                if tag == name or tag in SAME.get(name, ()):
                    while len(self._stack) > depth:
                        self._pop()
                    break
        if name in VOID:
            return
        hard, soft = self._named(name, attributes)
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.furniture.append(hard)
        self.soft.append(soft)
        self._stack.append(len(self.tag) - 1)

    def _named(self, name: str, attributes: str) -> tuple[bool, bool]:
        """Whether the element is furniture, and whether only its name says so."""
        if name in FURNITURE:
            return True, False
        if name in ("html", "body") or "=" not in attributes and "hidden" not in attributes.lower():
            return False, False
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            low = value.lower()
            if key == "role" and low in ROLES or key == "hidden" or key == "aria-hidden" and low == "true" or key == "style" and HIDDEN.search(low):
                return True, False
            if key in ("class", "id"):
                for token in value.split():
                    parts = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()))
                    if parts & STATES:
                        continue
                    if parts & COMMENTS and (name not in ("article", "main") or parts <= COMMENTS):
                        return True, False
                    if parts & NAMES and name not in ("article", "main") and (name not in PROSE or parts <= NAMES):
                        return True, True
        return False, False

    def _end(self, name: str) -> None:
        if name == "a":
            self._anchor = 0
            return
        if name == "p" and "p" not in (self.tag[k] for k in self._stack):
            self._flush()
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[depth]] == name:
                while len(self._stack) > depth:
                    self._pop()
                self._anchor = 0
                return


def main_text(html: str | None) -> str:
    """The article of a page: kept blocks joined by line breaks; "" if there is none.

    An article or main element around the best container is taken instead of it. An element that is furniture only by its name
    counts as content if it holds an article, a main element or a first-level heading; so does a header element inside an
    article, for its headings.
    """
    if not html:
        return ""
    page = Page(html)
    n = len(page.tag)
    holds = [False] * n
    for k in range(n - 1, 0, -1):
        if page.tag[k] in ("article", "main", "h1") or holds[k]:
            holds[page.parent[k]] = True
    within = [False] * n  # inside an article or main element
    dropped = [False] * n
    for k in range(1, n):
        up = page.parent[k]
        within[k] = within[up] or page.tag[up] in ("article", "main")
        own = page.furniture[k] and not (page.soft[k] and holds[k])
        if page.tag[k] == "header":
            own = not within[k]
        elif page.tag[up] == "header" and page.tag[k] not in HEADINGS:
            own = True
        dropped[k] = dropped[up] or own
    length, linked, links = [0] * n, [0] * n, [0] * n
    for k, text, inside, count in page.blocks:
        length[k] += len(text)
        linked[k] += inside
        links[k] += count
    for k in range(n - 1, 0, -1):  # an element comes after its parent, so one pass sums whole subtrees
        up = page.parent[k]
        length[up] += length[k]
        linked[up] += linked[k]
        links[up] += links[k]
    for k in range(1, n):  # lists of links are menus wherever they stand
        menu = page.tag[k] in ("ul", "ol", "div", "table", "section", "dl") and links[k] >= MENU_LINKS and linked[k] >= MENU_DENSITY * length[k]
        dropped[k] = dropped[k] or menu or dropped[page.parent[k]]

    points = [0.0] * n
    for k, text, inside, _ in page.blocks:
        if dropped[k]:
            continue
        plain = len(text) - inside
        worth = plain / 100 + text.count(",") * plain / len(text)
        k = page.parent[k] if page.tag[k] not in ("div", "section", "article", "main", "td", "body", "#root") else k
        points[k] += worth
    for k in range(n - 1, 0, -1):
        points[page.parent[k]] += points[k] / HALF_LIFE
    for k in range(n):
        points[k] *= 1 - linked[k] / length[k] if length[k] else 0
    candidates = [k for k in range(n) if not dropped[k] and points[k] > 0]
    if not candidates:
        return ""
    best = max(candidates, key=lambda k: (points[k], -k))
    k = page.parent[best]
    while k > 0:
        if page.tag[k] in ("article", "main") and not dropped[k]:
            best = k
        k = page.parent[k]
    kept = {best}
    if page.tag[best] not in ("article", "main", "body", "#root"):
        for k in range(1, n):
            if page.parent[k] == page.parent[best] and not dropped[k]:
                alike = points[k] >= SIBLING_SHARE * points[best]
                prose = page.tag[k] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "pre", "table") and linked[k] < 0.5 * max(length[k], 1)
                if alike or prose:
                    kept.add(k)
    inside = [False] * n
    for k in range(n):
        inside[k] = k in kept or k > 0 and inside[page.parent[k]]
    return "\n".join(text for k, text, _, _ in page.blocks if inside[k] and not dropped[k])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page and its length in code points; a map over the scan.

    A null or empty page, or one without content, has the text "" of length 0. Columns beyond ``keep`` are ignored, also such
    with names of the result; repeated rows give repeated results. Pages are read whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"],
            )

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    return pages.select(*[F.col(c) for c in keep], F.col(html).cast("string").alias("html")).mapInArrow(run, f"{carried}, text string, n_chars long")
