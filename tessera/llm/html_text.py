"""Main text of web pages by composite text density.

The page is parsed into a tree in one linear pass (implied end tags, raw text
elements, broken nesting). Every node gets the characters, tags, link characters
and link tags below it, and from them its composite text density: characters per
tag, scaled down where links make up much of it. Inline elements belong to the
block they stand in. A block's density sum is the sum over its child blocks and
its own line of text; the block with the largest sum is the heart of the article.

The path from there to the body decides how far the article reaches: it grows to
the next node of the path while that is at least ``STEP`` times as dense as the
last, so a heading, a byline or a short paragraph beside dense ones comes along,
and a container that also holds link lists does not. The least density on the rest
of the path is the threshold above which blocks beside the path count as content.
No element name selects the article: renamed to ``div``, an article or main element
gives the same text.

Set apart, so without density and never rendered: what the kind, role, visibility
or an unmistakable name marks as menu, footer, sidebar, notice, advert, form or
comment. Headers and elements with a doubtful name (``share``, ``related`` ...)
have no density either, but are rendered where they stand inside the article and
links are not most of them. An element with a telling name that holds most of the
page's text in paragraphs is not set apart.

Defined results: null or empty html, and pages without text outside such elements,
give the empty text; repeated pages are extracted alike, each on its own; there is
no limit on size or depth (no recursion, and time in proportion to the page); white
space is what ``str.split`` splits at; a page without any markup is one block. No
script is run: what stands in for one (``noscript``, ``object``) is content.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.rows import map_rows
from tessera.session import table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title select audio video canvas noframes annotation annotation-xml".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
    tr ul caption""".split()
)
#: Elements that never hold article text, and those of them that some pages wrap around everything.
APART = frozenset("nav footer aside form button dialog menu".split())
WRAPPERS = frozenset(["form"])
# Name parts by which pages mark what is no article, and parts that article elements carry as well.
APART_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner billboard cookie
    cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login signin nav
    navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer sidebar sidebars comment comments
    commentlist disqus respond reply replies masthead""".split()
)
DOUBTFUL_NAMES = frozenset("header topbar head alert rail widget share sharing social related recommended copyright toolbar skip search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
# An element of the key ends open elements of the values, up to the stop elements.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th table".split())
# Elements inside a drawing that hold HTML, and the HTML tags that end a drawing where they stand.
HTML_POINTS = frozenset("foreignobject desc title".split())
BREAKOUT = BLOCK | frozenset("b big br code em embed head i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
#: Least density of the next node of the path, as a share of the last one's, for the article to grow to it.
STEP = 0.5
NORMAL, DOUBTFUL, SET_APART = range(3)

_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "kind", "by_name", "block", "chars", "tags", "link_chars", "link_tags", "density", "total", "own", "own_tags", "own_link", "own_links")

    def __init__(self, tag: str, parent: Node | None, kind: int = NORMAL, by_name: bool = False):
        self.tag, self.parent, self.kind, self.by_name, self.block = tag, parent, kind, by_name, tag in BLOCK
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.own = self.own_tags = self.own_link = self.own_links = 0
        self.density = self.total = 0.0


def kind_of(tag: str, attributes: str) -> tuple[int, bool]:
    """(kind, whether by a name or a wrapper) of an element, from its tag, role, visibility and names."""
    if tag in APART:
        return SET_APART, tag in WRAPPERS
    kind = DOUBTFUL if tag == "header" else NORMAL
    if not attributes or tag in ("html", "body"):
        return kind, False
    found = {m.group(1).lower(): (m.group(2) or "").strip("\"'").lower() for m in _ATTR.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return SET_APART, False
    if found.get("role") in APART_ROLES:
        return SET_APART, True
    names = set(_PART.findall(f"{found.get('class', '')} {found.get('id', '')}"))
    if names & APART_NAMES:
        return SET_APART, True
    return (DOUBTFUL if names & DOUBTFUL_NAMES and tag not in HEADINGS else kind), False


class Marks:
    """The tags of a page, in one pass: every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.quotes = True  # off once a quoted value was found not to end
        self.none_after: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """Place of ``what``, or -1; that there is none is looked up only once."""
        if at >= self.none_after.get(what, self.size + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none_after[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, quoted values skipped, or -1."""
        now = at
        while self.quotes:
            stop = _STOP.search(self.page, now)
            if not stop:
                self.quotes = False
            elif stop.group() == ">":
                return stop.start()
            else:
                now = self.find(stop.group(), stop.end()) + 1
                self.quotes = now > 0
        return self.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(start, end, name, closing, attributes) of the next mark; comments and the like have no name, CDATA its text as attributes."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            two = page[start + 1 : start + 2]
            if two in ("!", "?"):
                if page.startswith("<!--", start):
                    end = self.find("-->", start + 4)
                    return start, end + 3 if end >= 0 else self.size, "", False, ""
                if page.startswith("<![CDATA[", start):
                    end = self.find("]]>", start + 9)
                    return start, end + 3 if end >= 0 else self.size, "", False, page[start + 9 : end if end >= 0 else self.size]
                end = self.find(">", start)
                return start, end + 1 if end >= 0 else self.size, "", False, ""
            closing = two == "/"
            head = start + 1 + closing
            letter = page[head : head + 1]
            if letter.isascii() and letter.isalpha():
                end = self.tag_end(head)
                if end < 0:
                    break
                name = _NAME.match(page, head).group()
                return start, end + 1, name.lower(), closing, page[head + len(name) : end]
            at = start + 1
        return self.size, self.size, "", False, ""


def raw_end(page: str, at: int, tag: str) -> int:
    """Where a raw text element that is open at ``at`` ends, its end tag included."""
    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    close = page.find(">", end.end()) if end else -1
    return close + 1 if close >= 0 else len(page)


def drawing_end(marks: Marks, at: int) -> int:
    """Where an svg that is open at ``at`` ends: after its end tag, or before an HTML tag that no drawing holds."""
    depth, inside = 1, 0
    while at < marks.size:
        start, at, name, closing, attributes = marks.next(at)
        if name in HTML_POINTS:
            inside = max(0, inside - 1) if closing else inside + (not attributes.rstrip().endswith("/"))
        elif name == "svg":
            depth += -1 if closing else not attributes.rstrip().endswith("/")
            if not depth:
                return at
        elif name and not inside and name in (BLOCK if closing else BREAKOUT):
            return start
    return marks.size


class Open:
    """The stack of open elements, with the places of every tag, of blocks and of table cells in it."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks, self.cells = [root], {}, [], []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.block:
            self.blocks.append(at)
        if node.tag in CELLS:
            self.cells.append(at)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def cut(self, at: int) -> None:
        """Close the elements from place ``at``."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.block:
                self.blocks.pop()
            if node.tag in CELLS:
                self.cells.pop()

    def close(self, tag: str) -> None:
        """An end tag: up to the open element it names, which one inside a table cell does not leave."""
        at = self.last(tag)
        if at and (tag in BLOCK or not self.cells or self.cells[-1] <= at):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """End what a start tag ends by itself."""
        if tag in BLOCK and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in ENDS:
            closes, stops = ENDS[tag]
            stop = max(self.last(t) for t in stops)
            first = [p[k] for t in closes if (p := self.places.get(t)) and (k := bisect_right(p, stop)) < len(p)]
            if first:
                self.cut(min(first))


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings, in page order."""
    root = Node("html", None)
    marks, opened, at = Marks(page), Open(root), 0

    def text(piece: str) -> None:
        if piece:
            opened.stack[-1].children.append(entities.unescape(piece) if "&" in piece else piece)

    while at < marks.size:
        before = at
        start, at, tag, closing, attributes = marks.next(at)
        text(page[before:start])
        if not tag:
            text(attributes)
        elif closing:
            opened.close(tag)
        elif tag == "svg" or tag in RAW:
            if not attributes.rstrip().endswith("/"):
                at = drawing_end(marks, at) if tag == "svg" else raw_end(page, at, tag)
        elif tag not in ("html", "head", "body"):
            opened.make_room(tag)
            node = Node(tag, opened.stack[-1], *kind_of(tag, attributes))
            node.parent.children.append(node)
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                opened.push(node)
    return root


def in_order(root: Node) -> list[Node]:
    """Elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Fill in densities and density sums; returns the blocks that take part."""
    nodes, in_link = in_order(root), set()
    page_chars = page_links = 0
    for n in nodes:
        if n.tag == "a" or id(n.parent) in in_link:
            in_link.add(id(n))
        n.own = sum(len(" ".join(c.split())) for c in n.children if isinstance(c, str))
        n.own_link = n.own * (id(n) in in_link)
        page_chars += n.own
        page_links += n.own_link
    texts = {id(n): [n.own, n.own_link, n.tag == "p" or n.tag in HEADINGS] for n in nodes}
    for n in reversed(nodes):  # all the text below a node, whatever is set apart
        if n.parent:
            n.parent.block |= n.block
            mine, above = texts[id(n)], texts[id(n.parent)]
            above[0] += mine[0]
            above[1] += mine[1]
            above[2] += mine[2]
    for n in nodes:
        chars, links, paragraphs = texts[id(n)]
        if n.kind == SET_APART and n.by_name and paragraphs >= 2 and 2 * (chars - links) > page_chars - page_links:
            n.kind = NORMAL
    gone, live = set(), []
    for n in nodes:
        if n.kind == SET_APART or id(n.parent) in gone:
            gone.add(id(n))
        else:
            live.append(n)
    share = page_links / max(1, page_chars)
    blocks = [n for n in live if n.block or n.parent is None]
    for n in reversed(live):
        n.chars, n.link_chars = n.chars + n.own, n.link_chars + n.own_link
        n.tags, n.link_tags = n.tags + n.own_tags, n.link_tags + n.own_links
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        n.total += density(n.own, n.own_tags, n.own_link, n.own_links, share)
        up = n.parent
        if not up or n.kind == DOUBTFUL:
            continue
        if n.block:
            up.chars, up.link_chars = up.chars + n.chars, up.link_chars + n.link_chars
            up.tags, up.link_tags = up.tags + n.tags + 1, up.link_tags + n.link_tags + (n.tag == "a")
            up.total += n.density
        else:  # part of its parent's own line
            up.own, up.own_link = up.own + n.chars, up.own_link + n.link_chars
            up.own_tags, up.own_links = up.own_tags + n.tags + 1, up.own_links + n.link_tags + (n.tag == "a")
    doubtful = set()
    for n in live:
        if n.kind == DOUBTFUL or id(n.parent) in doubtful:
            doubtful.add(id(n))
    return [n for n in blocks if id(n) not in doubtful]


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, adjusted for links."""
    if not chars:
        return 0.0
    per_tag = chars / max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return per_tag * math.log(max(ratio, 1.0) + 1) / max(base, 1.0)


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that are the article, in page order."""
    live = measure(root)
    best = max(live, key=lambda n: (n.total, n.parent is not None), default=None)  # the first of equals, the body last
    if best is None or not best.chars:
        return []
    whole = best
    while whole.parent and whole.parent is not root and whole.parent.density >= STEP * whole.density:
        whole = whole.parent
    path, up = [], whole
    while up:
        path.append(up)
        up = up.parent
    threshold = min(n.density for n in path)
    on_path, chosen, covered = {id(n) for n in path}, [], set()
    for n in live:
        if id(n.parent) in covered:
            covered.add(id(n))
        elif n is whole or id(n) not in on_path and n.density >= threshold and n.chars > n.link_chars * 2:
            covered.add(id(n))
            chosen.append(n)
    return chosen


def render(nodes: list[Node]) -> str:
    """Blocks in page order, one to a line; white space inside a block is one space."""
    blocks: list[str] = []
    current: list[str] = []

    def close() -> None:
        line = " ".join("".join(current).split())
        if line:
            blocks.append(line)
        current.clear()

    for root in nodes:
        stack: list = [root]
        while stack:
            n = stack.pop()
            if n is None:
                close()
            elif isinstance(n, str):
                current.append(n)
            elif n.kind == NORMAL or n.kind == DOUBTFUL and root.parent and n.chars >= n.link_chars * 2:
                if n.tag == "br":
                    current.append(" ")
                elif n.tag in BLOCK:
                    close()
                    stack.append(None)
                stack += reversed(n.children)
        close()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return render(main_nodes(parse(page))) if page else ""


def extract_pages(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` and the main text of every row; narrow, one page in memory at a time."""
    ddl = ", ".join([*(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys), "text string"])
    return map_rows(pages, [*keys, html], ddl, lambda: lambda *cols: ((*row[:-1], main_text(row[-1])) for row in zip(*cols)))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html_text": op7_html_text}
SQL: dict[str, str] = {}
