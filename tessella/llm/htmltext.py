"""Main-text extraction from HTML by composite text density.

A page is parsed into a tree of elements with implied end tags. For every
element the composite text density is computed from its characters, link
characters, tags and link tags; an element's density sum is the sum over its
children. The subtree with the greatest density sum is the seed of the article,
and the least density on the path from it to body is the threshold that its
parts and its surroundings must reach.

What names, roles and classes say of an element is a hint. An element that is
hinted to be no part of the article counts as such unless it is a wrapper: it
holds the page's marked article, or nearly all of its text, or most of it with
the main heading.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noembed noframes".split())
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in RAW}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li optgroup option tbody td tfoot th thead tr frameset".split())
DROPPED = RAW | frozenset("head nav aside footer button select dialog menu input audio video map applet".split())
HINTED = frozenset("form header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NOISE = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|sponsored|sponsor|promos?|promotion|sidebar|side-bar|menu|navbar|nav|navigation|breadcrumbs?|footer|masthead|cookies?|consent|notices?|banner|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommended|comments?|comment-list|disqus|respond|widget|toolbar|pagination|pager|skip-link|legal|disclaimer|copyright|gdpr|alert|login|signup)(?:[-_\s]|\d*$)", re.I)
#: Attributes as the standard reads them: a quote ends a value only where one began it.
ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?|=[^\s/>=]*+)*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*+{ATTRIBUTES}(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<=[\s/"'])(class|id|role|hidden|aria-hidden|style)(?=[\s/>=]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""", re.I)
SPACE = re.compile(r"\s+")
#: What an end tag of this kind may not close across.
SCOPE = {"p": frozenset("td th table caption button".split()), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


#: Shares of a page's text outside links that make a hinted element a wrapper, the second one together with the main heading.
WRAPS, HEADED = 0.9, 0.5
#: Share of a marked article's text in parts that reach the threshold from which the mark is followed.
MARKED = 0.5


class Node:
    __slots__ = ("name", "parent", "parts", "drop", "hint", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, drop: bool, hint: bool = False):
        self.name, self.parent, self.parts, self.drop, self.hint = name, parent, [], drop, hint
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and not p.drop]


def noise(name: str, tag: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is no part of an article, and whether its name or attributes hint at that."""
    if name in DROPPED:
        return True, False
    hint = name == "form" or name == "header" and not inside_article
    if name in ("html", "body", "article", "main"):
        return False, False
    for key, a, b, c in ATTRIBUTE.findall(tag[len(name) + 1 :]) if len(tag) > len(name) + 2 else ():
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True, False
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        hint = hint or key == "role" and value.lower() in ROLES or key in ("class", "id") and NOISE.search(value) is not None
    return False, hint


def parse(page: str) -> Node:
    """The element tree of a page; text is kept as strings among a node's parts."""
    root = at = Node("html", None, False)
    articles = place = 0
    while place < len(page):
        m = TOKEN.match(page, place)
        t, place = m.group(), m.end()
        if t[0] != "<" or len(t) == 1:
            at.parts.append(t)
            continue
        n = NAME.match(t)
        if not n:
            if t.startswith("<![CDATA["):
                at.parts.append(t[9:].removesuffix("]]>"))
            continue
        name = n.group(1).lower()
        if t[1] == "/":
            if name == "br":
                at.parts.append(" ")
                continue
            x, stop = at, SCOPE.get(name, ())
            while x is not root and x.name != name and x.name not in stop and not (name not in BLOCK and x.name in BLOCK):
                x = x.parent
            if x is not root and x.name == name:
                articles -= name in ("article", "main")
                at = x.parent
            continue
        if name in ("html", "body") and name != "body":
            continue
        if name in VOID:
            at.parts.append(Node(name, at, False) if name in ("hr", "img") else " " if name in ("br", "wbr") else "")
            continue
        if name in RAW:
            # only its own end tag ends a raw element
            if not t.endswith("/>"):
                end = RAW_END[name].search(page, place)
                place = end.end() if end else len(page)
            continue
        if name in CLOSES_P:
            x = at
            while x is not root and x.name != "p" and x.name not in SCOPE["p"] and (x.name not in BLOCK):
                x = x.parent
            if x is not root and x.name == "p":
                at = x.parent
        if name in SIBLINGS:
            x, hit = at, None
            while x is not root and x.name not in SCOPE[name]:
                if x.name in SIBLINGS[name]:
                    hit = x
                x = x.parent
            if hit is not None:
                at = hit.parent
        if name == "body" and at.name == "head":
            at = at.parent
        if at.name == "head" and name in BLOCK:
            at = at.parent
        node = Node(name, at, *noise(name, t, articles > 0))
        at.parts.append(node)
        if not t.endswith("/>") or name in BLOCK:
            at = node
            articles += name in ("article", "main")
    return root


def measure(root: Node) -> list[Node]:
    """Fill in counts and densities bottom-up; the kept nodes, parents first."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        n.clear()
        order.append(n)
        stack += n.children()
    for n in reversed(order):
        n.chars = sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        for p in n.children():
            n.chars += p.chars
            n.tags += p.tags + 1
            n.link_chars += p.chars if p.name == "a" else p.link_chars
            n.link_tags += p.link_tags + (p.name == "a")
    body_chars, body_links = max(1, root.chars), root.link_chars
    for n in order:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        if not c:
            continue
        plain = max(1, c - lc)
        base = math.log(c / plain * lc + body_links / body_chars * c + math.e)
        n.density = c / t * math.log(max(1.0 + 1e-9, (c / max(1, lc)) * (t / max(1, lt)))) / math.log(max(base, 1.0) + math.e - 1)
    for n in order:
        n.total = sum(p.density for p in n.children())
    return order


def drop_hinted(root: Node) -> None:
    """Drop the hinted elements that are no wrappers."""
    order = measure(root)
    if not any(n.hint for n in order):
        return
    marked, headed = set(), set()
    for n in reversed(order):
        if n.name in ("article", "main") and not n.hint or any(p in marked for p in n.children()):
            marked.add(n)
        if n.name == "h1" or any(p in headed for p in n.children()):
            headed.add(n)
    text = max(1, root.chars - root.link_chars)
    for n in order:
        if n.hint:
            share = (n.chars - n.link_chars) / text
            n.drop = not (n in marked or share >= WRAPS or share >= HEADED and n in headed)


def choose(root: Node) -> list[Node]:
    """The subtree that holds the article.

    The seed is the element with the greatest density sum, and the threshold the
    least density on the path from it to body. The seed is widened to its parent
    while nearly all of the parent's text lies in children that reach the
    threshold; and to the nearest element that the page marks as its article, if
    at least MARKED of that one's text does.
    """
    drop_hinted(root)
    order = measure(root)
    best = max(order, key=lambda n: n.total, default=root)
    if not best.total:
        return [root]
    path = [best, *ancestors(best)]
    threshold = min((p.density for p in path if p.name != "html" and p.density > 0), default=0.0)

    def share(p: Node) -> float:
        own = sum(len("".join(x.split())) for x in p.parts if isinstance(x, str)) if p is best else 0
        return (own + sum(c.chars for c in p.children() if c.density >= threshold or c.name[0] == "h" and c.name[1:].isdigit())) / max(1, p.chars)

    marked = next((p for p in path if p.name in ("article", "main")), None)
    if marked is not None and share(marked) >= MARKED:
        return [marked]
    top = best
    for p in path[1:]:
        if share(p) < 0.95:
            break
        top = p
    return [top]


def ancestors(n: Node) -> list[Node]:
    out = []
    while n.parent is not None:
        n = n.parent
        out.append(n)
    return out


def blocks(roots: list[Node]) -> list[str]:
    """The texts of the blocks below roots, in page order, white space squeezed."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        s = SPACE.sub(" ", entities.unescape("".join(now))).strip()
        now.clear()
        if s:
            out.append(s)

    for r in roots:
        stack: list = [r]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                now.append(x)
            elif not x.drop:
                if x.name in BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(x.parts)
        end()
    return out


def extract(page: str | None) -> str:
    """The main text of a page; empty for null, empty or textless pages."""
    return "\n\n".join(blocks(choose(parse(page)))) if page else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages, from its whole html.

    Null html counts as empty and gives an empty text; null ids and urls are
    kept; equal rows give equal rows; an empty table gives an empty result;
    other columns are ignored. Pages are independent: no shuffle.
    """

    def run(parts):
        for p in parts:
            text = [extract(h) for h in p["html"]]
            yield pd.DataFrame({"page_id": p["page_id"].astype("Int64"), "url": p["url"].astype(object), "text": pd.Series(text, dtype=object), "n_chars": [len(t) for t in text]})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
