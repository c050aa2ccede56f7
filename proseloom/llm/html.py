"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Kinds of elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CELLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Elements that never hold main text.
NEVER = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas button select textarea input "
    "dialog menu title audio video map".split()
)
#: Roles of elements that surround an article.
ROLES = frozenset("navigation complementary contentinfo search dialog banner menu menubar toolbar alertdialog".split())
#: Last words of class and id names that mark what surrounds an article.
ASIDE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie "
    "cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup share sharing social related "
    "recommended recommendations sidebar rail menu nav navigation navbar breadcrumb breadcrumbs pagination pager footer "
    "header masthead toolbar disqus".split()
)
#: Last words that mark reader comments.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses feedback discussion discussions".split())
#: Words that say nothing about what an element holds; the word before them counts.
GENERIC = frozenset(
    "area bar block box col column container content div group holder inner item items left links list outer page panel "
    "region right row section slot top unit wrap wrapper".split()
)
#: Names that speak about another element.
ABOUT = frozenset("has with no without hide".split())
#: Words that mark the article itself; a name that ends with one wins over the ones above, comments excepted.
MAIN = frozenset("article content main body entry post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BASE = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0, "ul": -3.0, "ol": -3.0, "form": -10.0}
#: A sibling joins the best container at this share of its score, or as a paragraph this long and free of links.
SIBLING, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25
#: Containers elsewhere at this share of the best score are part of the article.
COUSIN = 0.75
#: Cells of an article's table are kept up to this share of characters inside links.
CELL_LINKS = 0.5
#: A list beside the best container is left out above this share of characters inside links.
LINKED = 0.8


class _Node:
    __slots__ = ("tag", "parent", "dropped", "score", "chars", "links", "order")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, order: int):
        self.tag, self.parent, self.dropped, self.order = tag, parent, dropped, order
        self.score, self.chars, self.links = 0.0, 0, 0


def _said(name: str) -> tuple[str, list[str]]:
    """What a class or id name says its element is: the last word that is not generic, and all its words."""
    words = _WORDS.findall(name)
    if words and words[0] in ABOUT:
        return "", words
    kept = [w for w in words if w not in GENERIC]
    return (kept or words or [""])[-1], words


def _aside(tag: str, attrs: str, parent: _Node, named: bool) -> bool:
    """Whether an element stands beside the article: by its tag and, if ``named``, its class, id and role."""
    inside = _within(parent, "article")
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    names: list[str] = []
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            names += value.split()
        elif name == "role" and named and ROLES & set(value.split()):
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    if not named or tag in HEADINGS:
        return False
    main = surrounds = False
    for name in names:
        last, words = _said(name)
        if last in COMMENTS and not (last.startswith("discussion") and tag == "section"):
            return True
        if last in ("header", "masthead") and (inside or MAIN & set(words)):
            continue
        surrounds |= last in ASIDE
        main |= words[-1:] != [] and words[-1] in MAIN and last not in ASIDE
    return surrounds and not main


def _within(node: _Node | None, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _blocks(html: str, named: bool) -> list[tuple[_Node, str, int]]:
    """Text blocks in page order: the element, its text, and its characters inside links."""
    root = _Node("", None, False, 0)
    stack, out, parts = [root], [], []
    links = count = linked = 0
    holder = root

    def put(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1].dropped:
            parts.append(raw)
            if linked:
                links += len(raw.strip())

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((holder, text, min(links, len(text))))
        links = 0

    def pop(to: int) -> None:
        nonlocal linked, holder
        for node in stack[to:]:
            if node.tag == "a":
                linked -= 1
        if any(node.tag in BLOCK for node in stack[to:]):
            flush()
        del stack[to:]
        holder = next((n for n in reversed(stack) if n.tag in BLOCK), root)

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            put(html[at:])
            break
        found = _TOKEN.match(html, start)
        if not found:
            put(html[at : start + 1])
            at = start + 1
            continue
        put(html[at:start])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        attrs = found["attrs"] if found["tag"] else found["attrs2"] or ""
        if found["close"] or found["close2"]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if place:
                pop(place)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                put(" " if tag != "wbr" else "")
            continue
        if tag in BLOCK:
            if stack[-1].tag == "p" or any(n.tag == "p" for n in stack):
                pop(next(i for i, n in enumerate(stack) if n.tag == "p"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CELLS.get(tag, ()):
                    break
                if tag in CELLS and (stack[i].tag == tag or {stack[i].tag, tag} <= {"td", "th"} or {stack[i].tag, tag} <= {"dt", "dd"}):
                    pop(i)
                    break
            flush()
        elif tag == "a" and linked:
            pop(next(i for i, n in enumerate(stack) if n.tag == "a"))
        parent = stack[-1]
        count += 1
        dropped = parent.dropped or _aside(tag, attrs, parent, named)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = end.start() if end else size
        if attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if dropped and not parent.dropped and tag not in BLOCK:
            # What is dropped inside a paragraph leaves a gap, not a break.
            parts.append(" ")
        node = _Node(tag, parent, dropped, count)
        stack.append(node)
        if tag == "a":
            linked += 1
        if tag in BLOCK:
            holder = node
    flush()
    return out


def main_text(html: str | None) -> str:
    """Text of the article in a page, blocks joined by one newline.

    Each block of text earns a point, one per comma and up to three for its
    length.  Its parent gets all of them, the grandparent half, and those above
    a share that falls with distance; sums are discounted by the share of
    characters inside links.  The best container is kept whole, containers that
    score nearly like it too, and of the siblings of each those that score like
    it, read like paragraphs or are headings; a sibling list that is nearly all
    links is not.  In a table the other cells are kept unless they are mostly
    links.  Elements whose tag, role or name marks them as navigation, notices,
    adverts, forms or comments are left out before; if that leaves no text, names
    and roles decide nothing.
    """
    if not html:
        return ""
    return _best(_blocks(html, True) or _blocks(html, False))


def _up(node: _Node | None, tags: frozenset[str] | set[str]) -> _Node | None:
    """The node itself or its nearest ancestor of one of the tags."""
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def _best(blocks: list[tuple[_Node, str, int]]) -> str:
    nodes: dict[int, _Node] = {}
    for node, text, links in blocks:
        points = 1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)
        if node.tag in HEADINGS:
            points = 0.0
        own = node.tag not in ("p", "pre", "li", "dd", "dt", *HEADINGS)
        above, depth = (node if own else node.parent), 0
        walk: _Node | None = node
        while walk is not None:
            walk.chars += len(text)
            walk.links += links
            walk = walk.parent
        while above is not None and above.tag:
            if above.order not in nodes:
                nodes[above.order] = above
                above.score += BASE.get(above.tag, 0.0)
            above.score += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
            above, depth = above.parent, depth + 1
    if not nodes:
        return "\n".join(text for _, text, _ in blocks)

    def final(node: _Node) -> float:
        return node.score * (1 - node.links / max(node.chars, 1))

    def above_of(node: _Node) -> set[int]:
        out, walk = set(), node
        while walk is not None:
            out.add(walk.order)
            walk = walk.parent
        return out

    best = max(nodes.values(), key=lambda n: (final(n), -n.order))
    limit, line = SIBLING * final(best), above_of(best)
    # Containers elsewhere in the page that score nearly as well: the article goes on there.
    seeds = [best]
    for node in sorted(nodes.values(), key=lambda n: n.order):
        if final(node) >= max(COUSIN * final(best), 1.0) and not any(
                node.order in above_of(seed) or seed.order in above_of(node) for seed in seeds):
            seeds.append(node)
    keep, beside = {seed.order for seed in seeds}, set()

    def reads(text: str, links: int) -> bool:
        return (len(text) > SIBLING_CHARS or text[-1:] in ".!?…") and links < SIBLING_LINKS * len(text)

    parents = {seed.parent.order for seed in seeds if seed.parent is not None}
    table = _up(best, {"table"}) if best.tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else None
    for at, (node, text, links) in enumerate(blocks):
        if node.order in parents:
            if reads(text, links):
                beside.add(at)
            continue
        cell = _up(node, {"td", "th"}) if table is not None else None
        if cell is not None and table.order in above_of(cell) and cell.links <= CELL_LINKS * cell.chars:
            keep.add(cell.order)
        near = node
        while near is not None and near.parent is not None and near.parent.order not in parents:
            near = near.parent
        if near is None or near.parent is None or near.order in keep or near.order in line:
            continue
        listed = near.tag in ("ul", "ol", "menu", "dl") and near.links > LINKED * near.chars
        told = near.links < SIBLING_LINKS * near.chars and (near.tag == "p" or (len(text) > SIBLING_CHARS and reads(text, links)))
        alike = near.order in nodes and final(near) >= limit and not listed
        if near.tag in HEADINGS or told or alike:
            keep.add(near.order)
    out = []
    for at, (node, text, _) in enumerate(blocks):
        walk = node
        while walk is not None and walk.order not in keep:
            walk = walk.parent
        if walk is not None or at in beside:
            out.append(text)
    return "\n".join(out)


def extract(html: Column) -> Column:
    """:func:`main_text` of an HTML column; null and empty pages give the empty string."""

    @F.pandas_udf(T.StringType())
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in pages], dtype=object)

    return of(html)
