"""Main text of web pages: paragraphs give points to the elements around them, and the best container is kept."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text, shipped

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary
    table tbody td tfoot th thead title tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li dd dt td th figcaption caption summary address".split())
# An element ends an open one of these, as far out as the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = frozenset("html table td th caption template button object".split())
# What is never main text, by element, by role and by words of class and id.
DROPPED = frozenset(
    """script style noscript template head title nav aside footer menu button select textarea input iframe svg canvas
    object embed audio video map dialog noembed noframes xmp""".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
DROPPED_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion
    cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay sidebar sidebars menu menus nav
    navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist
    disqus reply replies respond share sharing social login skip""".split()
)
#: Words that drop an element only if none of MAIN_WORDS stands beside them.
WEAK_WORDS = frozenset("header banner notice notices alert alerts related recommended widget widgets search form copyright legal disclaimer discussion".split())
MAIN_WORDS = frozenset("article post entry content main story body text page".split())
#: These are dropped by their words even around an article.
TALK = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: A word after one of these tells what stands elsewhere, as in ``content-with-sidebar``.
NEGATIONS = frozenset("with has no without".split())
PLAIN = frozenset("html body main h1 a b i em strong u s small big sub sup font code q cite abbr mark".split())

COMMAS = re.compile("[,،、，]")
_SENTENCE = re.compile("[.!?…。！？]")
#: A sibling is kept with this share of the best container's score, or as a paragraph of a sentence.
SIBLING_SHARE = 0.2
MOST_LINKS = 0.5
#: A list with as many links and such a share of its text in links is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8

#: Elements nested deeper stand beside each other, as in browsers.
MOST_DEPTH = 512

_ATTRIBUTES = r"""(?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+"""
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """An element of the page. ``children`` holds elements and pieces of text in page order."""

    __slots__ = ("children", "depth", "links", "name", "parent", "role", "score", "size", "tag", "words")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.score, self.size, self.links = 0.0, 0, 0
        named = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _NAMED.findall(attributes)} if attributes.strip() else {}
        self.name, self.role = named.get("class", ""), named.get("role", "").strip().lower()
        words = re.split(r"[^a-z]+", _CAMEL.sub(" ", f"{self.name} {named.get('id', '')}").lower())
        self.words = {w for before, w in zip(["", *words], words, strict=False) if before not in NEGATIONS}
        if "hidden" in named or _HIDDEN.search(named.get("style", "")):
            self.role = "hidden"

    def inside(self, tags: frozenset | set) -> bool:
        up = self.parent
        while up is not None and up.tag not in tags:
            up = up.parent
        return up is not None

    def holds(self, tags: frozenset | set) -> bool:
        todo = [self]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, Element):
                    if c.tag in tags and not c.words & TALK:
                        return True
                    todo.append(c)
        return False

    def dropped(self) -> bool:
        if self.tag in DROPPED or self.role == "hidden":
            return True
        if self.tag in ("article", "main") and not self.words & TALK:
            return False
        if self.tag == "header" and not self.inside({"article", "main"}):
            return not self.holds({"article", "main"})
        if self.tag in ("form", "fieldset"):
            return not self.holds({"article", "main", "h1"})
        if self.tag in PLAIN:
            return False
        named = self.words & DROPPED_WORDS or self.role in DROPPED_ROLES or (self.words & WEAK_WORDS and not self.words & MAIN_WORDS)
        return bool(named) and (bool(self.words & TALK) or not self.holds({"article", "main"}))


def parsed(page: str) -> Element:
    """The tree of a page, with the ends that HTML lets authors leave out."""
    root = top = Element("html", None)
    at, n = 0, len(page)

    def end(tags: set[str], scopes: frozenset | set) -> None:
        nonlocal top
        up = top
        while up.parent is not None and up.tag not in tags:
            if up.tag in scopes:
                return
            up = up.parent
        if up.parent is not None:
            top = up.parent

    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            if top.tag == "head" and text.strip():
                top = top.parent
            top.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in ("html", "body"):
                end({tag}, SCOPES - {tag} if tag in BLOCKS else BLOCKS - {tag})
            continue
        if tag == "html" or (tag == "body" and top.inside({"body"})):
            continue
        if tag not in IN_HEAD:
            end({"head"}, BLOCKS - {"head"})
        if tag in BLOCKS:
            end({"p"}, SCOPES)
            if tag in HEADINGS and top.tag in HEADINGS:
                top = top.parent
        if tag in ENDS:
            end(*ENDS[tag])
        element = Element(tag, top, m[3])
        top.children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else n
            top = element
        elif element.depth < MOST_DEPTH and (tag in BLOCKS or not m[3].endswith("/")) and tag not in VOID:
            top = element
    return root


class Block:
    """Text between two borders of block elements, and the innermost block element around it."""

    __slots__ = ("at", "links", "text")

    def __init__(self, at: Element, text: str, links: int):
        self.at, self.text, self.links = at, text, links


def blocks_of(root: Element) -> list[Block]:
    """The blocks of what is not dropped, in page order; white space is one space."""
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []

    def flush(at: Element) -> None:
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            out.append(Block(at, text, sum(len("".join(p.split())) for p, linked in pieces if linked)))
        pieces.clear()

    todo: list[tuple] = [("open", root, root, False)]
    while todo:
        step, node, block, linked = todo.pop()
        if step == "text":
            pieces.append((node, linked))
        elif step == "flush":
            flush(block)
        elif node.tag in ("br", "wbr"):
            pieces.append((" " if node.tag == "br" else "", linked))
        elif not node.dropped():
            own = node.tag in BLOCKS
            if own:
                flush(block)
                todo.append(("flush", None, node, False))
            inner = node if own else block
            linked = linked or node.tag == "a"
            for c in reversed(node.children):
                todo.append(("open", c, inner, linked) if isinstance(c, Element) else ("text", c, inner, linked))
    return out


def _points(blocks: list[Block]) -> list[Element]:
    """Scores every element around the blocks: a paragraph's points go whole to its parent, half to the next, then
    less; links take their share away. Returns the scored elements in page order."""
    seen: dict[int, Element] = {}
    for b in blocks:
        points = 1 + len(COMMAS.findall(b.text)) + len(b.text) / 100
        up = b.at.parent if b.at.tag in PARAGRAPHS and b.at.parent is not None else b.at
        level = 0
        while up is not None:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            seen[id(up)] = up
            up, level = up.parent, level + 1
        up = b.at
        while up is not None:
            up.size, up.links = up.size + len("".join(b.text.split())), up.links + b.links
            up = up.parent
    for e in seen.values():
        e.score *= 1 - e.links / e.size
    return list(seen.values())


def _menu(e: Element) -> bool:
    if e.tag not in ("ul", "ol", "dl", "div", "section", "table", "p") or e.links < MENU_SHARE * e.size:
        return False
    n_links, todo = 0, [e]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Element):
                n_links += c.tag == "a"
                todo.append(c)
    return n_links >= MENU_LINKS


def _within(e: Element, roots: dict[int, Element]) -> bool:
    up: Element | None = e
    while up is not None:
        if id(up) in roots:
            return True
        up = up.parent
    return False


def main_blocks(page: str) -> tuple[list[str], str]:
    """The blocks of the main text, and where the best container stands."""
    blocks = blocks_of(parsed(page))
    if not blocks:
        return [], ""
    scored = _points(blocks)
    best = max(scored, key=lambda e: e.score)
    up: Element | None = best
    while up is not None and up.tag != "article":  # an article is kept whole, and so is the main part
        up = up.parent
    if up is None:
        up = best
        while up is not None and up.tag != "main":
            up = up.parent
    top = best if up is None else up
    roots = {id(top): top}
    sizes = {id(e): e for e in scored}
    if top.parent is not None:
        said_in: dict[int, list[str]] = {}
        for b in blocks:
            up = b.at
            while up is not None and up.parent is not top.parent:
                up = up.parent
            if up is not None:
                said_in.setdefault(id(up), []).append(b.text)
        for s in top.parent.children:
            if not isinstance(s, Element) or s is top or s.size == 0:
                continue
            density = s.links / s.size
            alike = s.tag == top.tag and s.name == top.name and s.tag not in PARAGRAPHS
            strong = id(s) in sizes and s.score >= SIBLING_SHARE * best.score
            said = s.tag in PARAGRAPHS and (s.tag in HEADINGS or s.size > 80 or any(_SENTENCE.search(t) for t in said_in[id(s)]))
            if density < MOST_LINKS and (alike or strong or said):
                roots[id(s)] = s
    loose = {id(top.parent)} if top.parent is not None else set()
    kept, menus = [], {}
    for b in blocks:
        # text that stands beside the container, outside any element of its own, is a sibling as well
        if not (_within(b.at, roots) or (id(b.at) in loose and len(b.text) > 80 and b.links < MOST_LINKS * len(b.text))):
            continue
        up, in_menu = b.at, False
        while up is not None and id(up) not in roots and not in_menu:
            if id(up) not in menus:
                menus[id(up)] = _menu(up)
            in_menu, up = menus[id(up)], up.parent
        if not in_menu:
            kept.append(b.text)
    path, up = [], top
    while up is not None:
        path.append(up.tag)
        up = up.parent
    return kept, "/".join(reversed(path))


FOUND = "text string, n_chars long, n_blocks long, container string"


def _found(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in pages:
        found = [main_blocks(p) for p in some]
        texts = ["\n".join(b) for b, _ in found]
        columns = {"text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(b) for b, _ in found], "container": [c for _, c in found]}
        yield pd.DataFrame(columns)


def main_text(page: Column) -> Column:
    """Main text of an HTML page as a struct: text, n_chars, n_blocks and container (the path of the best one).

    Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments are dropped by
    element, role and words of class and id. Each block that is left gives points for its length and its commas to the
    elements around it, discounted by the share of their text in links; the best one is kept, with its whole
    ``article`` or ``main`` if it has one, and with siblings that score or read like it. Of equal scores the one that
    gets points first wins. Character references are decoded, white space inside a block (no-break spaces too) is
    one space, blocks are joined by a line feed. Nothing else is dropped or cut.

    A null or empty page, or one without text, gives an empty text. Broken and cut markup is read as browsers do, as
    far as ends are concerned; a tag that the page's end cuts is dropped. A page is judged by itself, whole, so
    repeated rows are judged alike; the cost is linear in its length, and one page is held in memory. As a column
    function it touches no other column of a frame.
    """
    return F.pandas_udf(_found, FOUND)(kept_text(page))


shipped(__name__)
