"""Pages as trees of elements: reading markup, hashing subtrees, and the blocks of text that are left.

Markup is read once and forgivingly: raw elements (script, style, ...) end at their end tag, comments and declarations are skipped,
an end tag closes the element it names and all that is open inside, blocks close open paragraphs, and what is open at the end stays
open to the end. Nothing recurses, so depth does not matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash

#: Fixed values of the HTML standard: elements without content, elements whose content is no markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main "
    "menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split())
CELLS = frozenset({"td", "th"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes these elements, unless one of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
PARAGRAPH_BOUNDS = {"td", "th", "button", "caption", "object"}
#: Elements that are never main text.
NOISE = frozenset(
    "head title script style noscript template nav footer aside button select option datalist input textarea label fieldset legend dialog iframe object embed applet "
    "svg canvas audio video map menu search noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that name something other than the main text, and those that wrappers of the main text carry as well.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar footer topbar "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login paywall "
    "share sharing social comment comments disqus respond reply replies related recommended".split())
SOFT_NAMES = frozenset("banner sidebar sidebars aside popup modal overlay widget widgets".split())
HEADER_NAMES = frozenset("header masthead".split())
NO, HEADER, SOFT, HARD = range(4)

_TEXT = re.compile(r"[^<]+")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_CUT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def kind_of(tag: str, attributes: str) -> int:
    """How far tag and attributes speak against an element: HARD, SOFT (unless most text lies in it), HEADER or NO."""
    kind = HARD if tag in NOISE else SOFT if tag == "form" else HEADER if tag == "header" else NO
    if kind == HARD or not attributes or tag in ("html", "body", "main"):
        return kind
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return HARD
        if name == "role" and ROLES & set(value.lower().split()):
            return HARD
        if name in ("class", "id"):
            words = {w.lower() for w in _WORDS.findall(value)}
            if words & NAMES:
                return HARD
            kind = max(kind, SOFT if words & SOFT_NAMES else HEADER if words & HEADER_NAMES else NO)
    return kind


class Page:
    """Elements in page order (parents first; element 0 is the page) and pieces of text, each of one element."""

    def __init__(self, markup: str):
        self.tag, self.parent, self.kind = [""], [-1], [NO]
        self.digest, self.chars = [b""], [0]
        self._content: list[list[bytes]] = [[]]
        #: (element, text); None in place of text where a block begins or ends.
        self.pieces: list[tuple[int, str | None]] = []
        self._stack = [0]
        self._open: Counter[str] = Counter()
        #: Open paragraphs and what bounds their scope, innermost last.
        self._scope: list[str] = []
        self._read(markup)

    def _read(self, markup: str) -> None:
        at, end = 0, len(markup)
        while at < end:
            found = _TEXT.match(markup, at)
            if found:
                self._add_text(html.unescape(found.group()))
                at = found.end()
                continue
            found = _TAG.match(markup, at) or _CUT_TAG.match(markup, at)
            if found:
                at = found.end()
                tag = found.group(2).lower()
                if found.group(1):
                    self._end(tag)
                else:
                    self._start(tag, found.group(3))
                    if tag in RAW:
                        closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(markup, at)
                        at = closing.start() if closing else end
                continue
            after = markup[at + 1:at + 2]
            if after in ("!", "?", "/"):
                closing = "-->" if markup.startswith("<!--", at) else ">"
                to = markup.find(closing, at + 2)
                at = end if to < 0 else to + len(closing)
            elif after.isascii() and after.isalpha():
                at = end  # a tag that never ends
            else:
                self._add_text("<")
                at += 1
        while self._stack:
            self._close()

    def _add_text(self, text: str) -> None:
        element = self._stack[-1]
        self.pieces.append((element, text))
        words = text.split()
        if words:
            text = " ".join(words)
            self._content[element].append(b"\0" + text.encode("utf-8", "surrogatepass"))
            self.chars[element] += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and self._scope and self._scope[-1] == "p":
            self._close_open({"p"}, PARAGRAPH_BOUNDS)
        if tag in CLOSES and any(self._open[t] for t in CLOSES[tag][0]):
            self._close_open(*CLOSES[tag])
        element = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.kind.append(kind_of(tag, attributes))
        self.digest.append(b"")
        self.chars.append(0)
        self._content.append([])
        if tag in BLOCK:
            self.pieces.append((element, None))
        elif tag == "br" or tag in CELLS:
            self.pieces.append((element, " "))
        if tag not in VOID:
            self._stack.append(element)
            self._open[tag] += 1
            if tag == "p" or tag in PARAGRAPH_BOUNDS:
                self._scope.append(tag)

    def _close_open(self, tags: set[str], bounds: set[str]) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in tags:
                return self._close_to(depth)
            if tag in bounds:
                return

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            return
        inline = tag not in BLOCK and tag not in CELLS
        for depth in range(len(self._stack) - 1, 0, -1):
            here = self.tag[self._stack[depth]]
            if here == tag:
                return self._close_to(depth)
            if inline and (here in BLOCK or here in CELLS):
                return

    def _close_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._close()

    def _close(self) -> None:
        """Digest of the element on top, from its tag, its text and its children with text in order; noted in its parent."""
        element = self._stack.pop()
        tag, above = self.tag[element], self.parent[element]
        self._open[tag] -= 1
        if tag == "p" or tag in PARAGRAPH_BOUNDS:
            self._scope.pop()
        content = self._content[element]
        self.digest[element] = xxhash.xxh3_128_digest(tag.encode("utf-8", "surrogatepass") + b"".join(content))
        self._content[element] = []
        if above >= 0 and self.chars[element]:
            self._content[above].append(b"\1" + self.digest[element])
            self.chars[above] += self.chars[element]
        if tag in BLOCK:
            self.pieces.append((element, None))
        elif tag in CELLS:
            self.pieces.append((element, " "))

    def kept(self) -> list[bool]:
        """Per element, whether its own text may be main text, before subtrees of the site's template go.

        The main text lies in the outermost articles, in the main element, or (with neither) anywhere. Of a header only the
        headings are kept, and nothing if it heads the whole page.
        """
        n = len(self.tag)
        root = self._roots()
        keep, heads = [True] * n, [False] * n
        for e in range(1, n):
            above, tag, kind = self.parent[e], self.tag[e], self.kind[e]
            if kind == SOFT and not root and 2 * self.chars[e] > self.chars[0]:
                kind = NO
            keep[e] = keep[above] and kind != HARD and kind != SOFT
            heads[e] = heads[above] or kind == HEADER
            if e in root:
                keep[e], heads[e] = True, False
            elif kind == HEADER and self.tag[above] in ("", "html", "body"):
                keep[e] = False
        heading, inside = [False] * n, [not root] * n
        for e in range(1, n):
            above = self.parent[e]
            heading[e] = heading[above] or self.tag[e] in HEADINGS
            inside[e] = inside[above] or e in root
        return [keep[e] and inside[e] and (heading[e] or not heads[e]) for e in range(n)]

    def _roots(self) -> set[int]:
        """The outermost article, or the main element, or several outermost articles; articles and mains in noise only if there are no others."""
        n = len(self.tag)
        under, noisy = [False] * n, [NO] * n
        articles: dict[bool, list[int]] = {False: [], True: []}
        mains: list[int] = []
        for e in range(1, n):
            above, tag = self.parent[e], self.tag[e]
            noisy[e] = max(noisy[above], self.kind[e] if self.kind[e] != HEADER else NO)
            under[e] = under[above]
            if tag == "article" and not under[e] and self.kind[e] != HARD and self.chars[e]:
                under[e] = True
                articles[noisy[above] != NO].append(e)
            elif tag == "main" and self.chars[e]:
                mains.append(e)
        found = articles[False] or ([] if mains else articles[True])
        if len(found) != 1 and mains:
            return set(mains[:1])
        return set(found)

    def subtrees(self, keep: list[bool]) -> set[bytes]:
        """Digests of the kept blocks that hold text."""
        return {self.digest[e] for e in range(1, len(self.tag)) if keep[e] and self.chars[e] and self.tag[e] in BLOCK and self.tag[e] not in ("html", "body")}

    def without(self, keep: list[bool], recurring: frozenset[bytes]) -> list[bool]:
        """``keep`` without the blocks whose digest recurs, and all that lies in them."""
        gone = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            gone[e] = gone[self.parent[e]] or self.tag[e] in BLOCK and self.digest[e] in recurring
        return [k and not g for k, g in zip(keep, gone)]

    def text(self, keep: list[bool]) -> str:
        """The kept blocks in page order: white space made one space, joined by empty lines."""
        blocks, now = [], []
        for element, piece in self.pieces:
            if piece is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif keep[element]:
                now.append(piece)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n\n".join(b for b in blocks if b)
