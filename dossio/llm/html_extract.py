"""Main text of web pages by composite text density over the DOM.

Parts that by their element, role, class or id aren't the article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) count as link text in the densities and are left out
of the result.  A class or id alone never drops the article: see _settle.  For every other node

    density = C / T * ln(C * T / (LC * LT)) / ln(ln(C / (C - LC) * LC + LCb / Cb * C + e**e))

with C characters and T tags below the node, LC characters and LT tags of links, b the body (each at least
1 where it divides).  Elements that only mark up words (neither links nor blocks, nor around any) are no tags and
no nodes here: their text is their parent's, so a bold passage isn't denser than its paragraph.  The node with the largest sum of its children's densities is the core.  The least
density on the path from the body to the core is the threshold: while a sibling of the subtree reaches it,
the subtree grows to its parent.

Defined results: a null, empty or textless html gives the empty text; malformed markup is closed as
browsers do for paragraphs, items and cells; repeated rows each get theirs; an empty table gives no rows;
other columns are ignored.  Reading the markup takes time in proportion to it, however deep or broken.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold the article's text.
ASIDE = frozenset("head script style noscript template nav footer aside button select option textarea input iframe object svg canvas dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Parts of a class or id that name what isn't the article.
NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those of them that name other people's text.
OTHERS = frozenset("comment comments disqus related replies reply respond".split())
#: First words of a class that tell what stands beside the text, not what the element is.
MODIFIERS = frozenset("has with no without".split())
#: Elements that are no text even on a page that has nothing else.
TEXTLESS = ASIDE - {"aside", "dialog"}
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
#: A start tag of the first kind closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Elements that an open paragraph outside them isn't closed through, and that inline end tags don't reach through.
P_SCOPE = ("td", "th", "li", "div", "article", "section", "blockquote", "table")
BARRIERS = ("article", "body", "table", "td", "th")


class Node:
    __slots__ = ("tag", "up", "down", "aside", "named", "link", "in_article", "in_body", "blocks", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, up: Node | None, aside: bool, named: int, link: bool):
        self.tag, self.up, self.down, self.aside, self.named, self.link = tag, up, [], aside, named, link
        self.in_article = tag in ("article", "main") or (up is not None and up.in_article)
        self.in_body = tag == "body" or (up is not None and up.in_body)
        self.blocks = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0

    def is_tag(self) -> bool:
        """Whether it is a block, a link, or stands around blocks."""
        return self.tag in BLOCKS or self.tag == "a" or self.blocks > 0


def _is_aside(tag: str, attrs: list, up: Node) -> bool:
    """By its element, role or hiding."""
    if tag in ASIDE:
        return True
    if tag == "header" and not up.in_article:
        return True
    return tag not in ("html", "body", "main") and any(k == "role" and v and v.lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)


def _named(tag: str, attrs: list, up: Node) -> int:
    """0: it's no form and no class or id names an aside; else how many times the text kept beside it its own must exceed to be the article."""
    if tag in ("html", "body", "main"):
        return 0
    found = int(tag == "form")
    for k, v in attrs:
        if k in ("class", "id") and v:
            for part in v.split():
                words = [w.lower() for w in SPLIT.split(part) if w]
                hit = NAMES.intersection(words)
                if not hit or words[0] in MODIFIERS or (hit == {"header"} and up.in_article):
                    continue
                found = max(found, 9 if OTHERS & hit or len(hit) == len(set(words)) else 1)
    return found


def _settle(nodes: list[Node]) -> None:
    """Decides which named nodes are aside, and hands that down.

    A name is lifted from whatever holds a main element.  In each scope (an article or main element, else the
    page) it is then lifted from the named node with the most text outside links, if that is more than all the
    scope keeps without it (nine times, where the name is plain or of others' text), and so on.  Where the page
    keeps text of an article or main element, only named nodes with such an element inside are tried.
    """
    if not any(n.named for n in nodes):
        return
    plain, holds = {}, {}
    for n in reversed(nodes):
        if n.aside or n.link:
            plain[n], holds[n] = 0, ""
            continue
        below = [x for x in n.down if isinstance(x, Node)]
        plain[n] = sum(len("".join(x.split())) for x in n.down if isinstance(x, str)) + sum(plain[x] for x in below)
        inside = {holds[x] for x in below}
        holds[n] = ("main" if n.tag == "main" or "main" in inside else "article" if n.tag == "article" or "article" in inside else "") if plain[n] else ""
    for n in nodes:
        if holds[n] == "main":
            n.named = 0
    while True:
        scope, dropped, kept, tried, found = {}, set(), {}, {}, False
        for n in nodes:
            up = n.up
            scope[n] = n if up is None or n.tag in ("article", "main") else scope[up]
            if up is not None and up in dropped or n.aside or n.link:
                dropped.add(n)
            elif n.named:
                dropped.add(n)
                tried.setdefault(scope[up], []).append(n)
            else:
                size = sum(len("".join(x.split())) for x in n.down if isinstance(x, str))
                kept[scope[n]] = kept.get(scope[n], 0) + size
                found = found or (size > 0 and scope[n].up is not None)
        lifted = False
        for s, them in tried.items():
            page = s.up is None
            if page and found:
                them = [n for n in them if holds[n]]
            held = sum(kept.values()) if page else kept.get(s, 0)
            best = max(them, key=plain.__getitem__, default=None)
            while best is not None and plain[best] > held * (1 if page and holds[best] else best.named):
                lifted = lifted or best.named > 0
                best.named = 0
                best = next((x for x in best.down if isinstance(x, Node) and plain[x] == plain[best]), None)  # wrappers of the same text at once
        if not lifted:
            break
    for n in nodes:
        n.aside = n.aside or n.named > 0 or (n.up is not None and n.up.aside)


class Tree(HTMLParser):
    """The nodes of a page.  ``path`` holds the open ones, ``depths`` for each tag the places of its open ones in the path."""

    def __init__(self, loose: bool = False):
        super().__init__(convert_charrefs=True)
        self.loose = loose
        self.root = Node("#root", None, False, 0, False)
        self.nodes, self.path, self.depths = [self.root], [self.root], {}

    def _close(self, depth: int) -> None:
        """Closes the open node at a depth, and those in it."""
        while len(self.path) > depth:
            self.depths[self.path.pop().tag].pop()

    def _innermost(self, tags) -> int:
        """The depth of the innermost open node of the tags; 0 where none is open."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def _close_open(self, tags, scope) -> None:
        """Closes the innermost open node of the tags, if it stands inside the innermost one of the scope."""
        if (depth := self._innermost(tags)) > self._innermost(scope):
            self._close(depth)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close_open(("p",), P_SCOPE)
        if tag in CLOSES:
            self._close_open(CLOSES[tag], SCOPE[tag])
        up = self.path[-1]
        aside = tag in TEXTLESS if self.loose else _is_aside(tag, attrs, up)
        node = Node(tag, up, up.aside or aside, 0 if self.loose else _named(tag, attrs, up), up.link or tag == "a")
        up.down.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.path))
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash doesn't close elements of HTML

    def handle_endtag(self, tag):
        depth = self._innermost((tag,))
        if depth and (tag in BLOCKS or depth > self._innermost(BARRIERS)):  # a stray inline end tag closes nothing outside its block
            self._close(depth)

    def handle_data(self, data):
        self.path[-1].down.append(data)


def _weigh(nodes: list[Node]) -> Node:
    """Counts and densities; returns the body, or the root without one.  Children follow their parents in ``nodes``."""
    for n in reversed(nodes):
        own = sum(len("".join(x.split())) for x in n.down if isinstance(x, str))
        n.chars += own
        if n.link or n.aside:
            n.link_chars, n.link_tags = n.chars, n.tags
        if n.up is not None:
            up = n.up
            up.chars += n.chars
            up.tags += n.tags + n.is_tag()
            up.blocks += n.blocks + (n.tag in BLOCKS)
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags + (n.is_tag() and (n.link or n.aside))
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.chars and not n.aside and n.is_tag():
            c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, max(1, n.link_tags)
            base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e**math.e))
            n.density = c / t * max(0.0, math.log(c * t / (max(1, lc) * lt))) / base
    return body


def _core(body: Node, nodes: list[Node]) -> Node:
    """The subtree with the article: the node with the largest sum of its children's densities, grown by the threshold of its path."""
    best, most = body, -1.0
    for n in nodes:
        if n.aside or not (n.in_body or body.up is None) or not (n.is_tag() or n is body):
            continue
        total = sum(x.density for x in n.down if isinstance(x, Node))
        if total == 0.0 and n.chars > n.link_chars:
            total = n.density
        if total > most:
            best, most = n, total
    threshold, n = body.density, best
    while n is not None and n is not body:
        threshold, n = min(threshold, n.density), n.up
    while best is not body and best.up is not None and any(isinstance(x, Node) and x is not best and not x.aside and x.density > 0 and x.density >= threshold for x in best.up.down):
        best = best.up
    return best


def _text(top: Node) -> str:
    """The blocks of text below ``top``, in page order, one a line."""
    lines: list[str] = []
    held: list[str] = []

    def flush():
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            lines.append(line)

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif not x.aside:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            elif x.tag == "br":
                held.append(" ")
            todo.extend(reversed(x.down))
    flush()
    return "\n".join(lines)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    for loose in (False, True):  # where all text is aside, only elements that are never text count
        tree = Tree(loose)
        tree.feed(html)
        tree.close()
        _settle(tree.nodes)
        text = _text(_core(_weigh(tree.nodes), tree.nodes))
        if text:
            break
    return text


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
