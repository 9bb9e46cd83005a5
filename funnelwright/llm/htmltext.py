"""Main text of HTML pages by composite text density.

For every node of the parsed page: characters C and tags T below it, link characters LC and link
tags LT. Its composite density is C/T, adjusted for links by a logarithm whose base grows with the
share of link text on the page and below the node. The density sum of a node adds the densities of
its children. From the node with the largest sum the path to body is walked; the smallest density on
it is the threshold. The chosen subtree is the one of the largest density sum; it grows to its
parent while it holds less than a share of the text that passes the threshold there. A page's only
article element is preferred where it holds that share. Inside, elements that are never part of an
article are left out, and so are blocks below the threshold that are mostly links. Class and id words
only count where the measures agree: a marked node goes if its density is far below the page's or
it is mostly links, or if a whole class or id is a plain name of such a part; never if it holds most
of the page's text. A form is such a part too, unless it holds most of the text or an article.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelwright.llm.common import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of a page, whatever their density.
UNSEEN = frozenset("script style noscript template head title svg canvas iframe object audio video map datalist annotation annotation-xml".split())
#: Parts of a page beside its article, by element, role or class word.
ASIDE = frozenset("nav footer aside button select textarea input label dialog menu".split())
#: Parts that may also be wrapped around a whole page.
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
MARKS = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|popup|modal"
    r"|newsletter|subscribe|subscription|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|replies|discussion|disqus"
    r"|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|skip)(?:$|[-_\s\d])",
    re.IGNORECASE,
)
#: Names that as a whole class or id say what a node is.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored cookie cookies popup modal newsletter sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer comment comments replies disqus toolbar pagination pager".split()
)
#: A marked node below this share of the page's density is beside the article.
SPARSE = 0.5
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Opening one of these ends an open paragraph; the others end an open element of the same kind.
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt option optgroup legend summary".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIBLINGS |= {k: {"tbody", "thead", "tfoot", "tr", "td", "th"} for k in ("tbody", "thead", "tfoot")}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Share of the passing text that the chosen subtree must hold.
SHARE = 0.8
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("article", "aside", "chars", "children", "density", "form", "links", "marked", "named", "parent", "tag", "tags", "total", "link_tags")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False) -> None:
        self.tag, self.parent, self.aside = tag, parent, aside
        self.article = tag in ("article", "main")
        self.form = self.marked = self.named = False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0


class Tree(HTMLParser):
    """Lenient tree: unclosed and crossed elements end where browsers end them, roughly."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#root", None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body", "head") and self._inside(tag):
            return
        if self.open.tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            self.open = self.open.parent
        if tag in ENDS_P:
            self._close("p", BLOCKS - {"p"})
        if tag in SIBLINGS:
            scope = SCOPES.get(tag, {"table"})
            node = self.open
            while node.tag not in scope and node.parent is not None:
                if node.tag in SIBLINGS[tag]:
                    self.open = node.parent
                node = node.parent
        if tag == "a":
            self._close("a", BLOCKS)
        given = {k: v or "" for k, v in attrs}
        words = f"{given.get('class', '')} {given.get('id', '')}"
        aside = (
            tag in ASIDE
            or given.get("role", "").lower() in ROLES
            or "hidden" in given
            or given.get("aria-hidden", "").lower() == "true"
            or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.IGNORECASE))
        )
        node = Node(tag, self.open, aside)
        if tag not in ("html", "body", "article", "main"):
            node.marked = bool(MARKS.search(words))
            node.named = not NAMES.isdisjoint(words.lower().split())
            node.form = tag in FORMS or given.get("role", "").lower() == "form"
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close(tag, frozenset() if tag in BLOCKS else BLOCKS)

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)

    def _inside(self, tag: str) -> bool:
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        return node is not None

    def _close(self, tag: str, barrier: frozenset[str]) -> None:
        node = self.open
        while node is not None and node.tag != tag:
            if node.tag in barrier:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _order(root: Node) -> list[Node]:
    """All nodes that can be seen, parents first; a list instead of recursion, as pages nest deeply."""
    found, at = [root], 0
    while at < len(found):
        found += [x for x in found[at].children if isinstance(x, Node) and x.tag not in UNSEEN]
        at += 1
    return found


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, densities and sums; gives the nodes, parents first."""
    nodes = _order(root)
    inside_link = {id(root): False}
    for node in nodes[1:]:
        inside_link[id(node)] = node.tag in ("a", "button", "select") or inside_link[id(node.parent)]
    for node in reversed(nodes):
        own = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        node.chars += own
        if inside_link[id(node)]:
            node.links += own
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
            up.article |= node.article
    page = next((n for n in nodes if n.tag == "body"), root)
    page_links = page.links / page.chars if page.chars else 0.0
    for node in nodes:
        if node.chars:
            tags, links, link_tags = max(1, node.tags), max(1, node.links), max(1, node.link_tags)
            plain = max(1, node.chars - node.links)
            base = math.log(node.chars / plain * links + page_links * node.chars + math.e)
            # Small where a node is mostly links: C/LC * T/LT, to the base that grows with links.
            lift = math.log(max(node.chars / links * tags / link_tags, 1.0)) / math.log(base)
            node.density = node.chars / tags * lift
    for node in nodes[1:]:
        node.parent.total += node.density
        if not node.marked and not node.form:
            continue
        if 2 * (node.chars - node.links) <= page.chars - page.links:
            node.aside |= node.form and not node.article
            node.aside |= node.marked and ( node.named or node.density < SPARSE * page.density or 2 * node.links > node.chars)
    return nodes


def _is_aside(node: Node) -> bool:
    return node.aside or (node.tag == "header" and not _within(node, ("article", "main")))


def _within(node: Node, tags: tuple[str, ...]) -> bool:
    up = node.parent
    while up is not None and up.tag not in tags:
        up = up.parent
    return up is not None


def _passing(nodes: list[Node], threshold: float) -> dict[int, int]:
    """Characters in each subtree outside of parts that are aside or below the threshold and mostly links."""
    found: dict[int, int] = {}
    for node in reversed(nodes):
        if _is_aside(node) or _linky(node, threshold):
            found[id(node)] = 0
            continue
        own = sum(len("".join(c.split())) if isinstance(c, str) else found.get(id(c), 0) for c in node.children)
        found[id(node)] = own
    return found


def _linky(node: Node, threshold: float) -> bool:
    return node.tag in BLOCKS and node.density < threshold and 2 * node.links > node.chars > 0


def main_text(html: str | None) -> str:
    """The text of the chosen subtree: its blocks in page order, one to a line."""
    if not html:
        return ""
    root = parse(html)
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    # Parents come first: what is hidden, or in the body, is handed down.
    hidden, inside = set(), {id(body)}
    for node in nodes:
        if _is_aside(node) or id(node.parent) in hidden:
            hidden.add(id(node))
        if id(node.parent) in inside:
            inside.add(id(node))
    seen = [n for n in nodes if id(n) not in hidden and n.chars and id(n) in inside]
    if not seen:
        return ""
    # Sums of what can be article only: parts beside it add nothing.
    sums = {id(n): 0.0 for n in seen}
    for node in seen:
        if node.parent is not None and id(node.parent) in sums:
            sums[id(node.parent)] += node.density
    best = max(seen, key=lambda n: sums[id(n)] or n.density / 1e6)
    path, threshold = best, best.density
    while path is not None and path is not body.parent:
        if path.density:
            threshold = min(threshold, path.density)
        path = path.parent
    own = next((n for n in seen if n.tag == "article"), None) if sum(n.tag == "article" for n in seen) == 1 else None
    passing = _passing(nodes, threshold)
    enough = SHARE * passing[id(body)]
    if own is not None and passing[id(own)] >= enough:
        best = own
    else:
        while best is not body and passing[id(best)] < enough and best.parent is not None:
            best = best.parent
    return "\n".join(_blocks(best, threshold))


def _blocks(top: Node, threshold: float) -> list[str]:
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(text)
        parts.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag not in UNSEEN and (x is top or not (_is_aside(x) or _linky(x, threshold))):
            if x.tag in BLOCKS:
                end()
                todo.append(None)
            todo += reversed(x.children)
    end()
    return blocks


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text in an article's place, give an empty text. Whole
    pages are read; repeated rows, null ids and urls pass through, extra columns are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", F.col("html")).mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
