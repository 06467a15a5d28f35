"""A small tolerant HTML reader: block nodes with their texts and counts.

Only structural elements become nodes; the text of inline elements belongs to the node around
them. Tags that are not closed, wrongly nested or unknown never fail. Tags are read as browsers
read them: a quote opens a value only after an equals sign, so a stray one is part of a name or
of a bare value. Time is in line with the length of a page, however deep it nests: each node
knows the nearest open paragraph, list item and table part, and open elements are counted by name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that do not end the head, and those of them that have no contents.
HEAD_VOID = frozenset("base link meta".split())
RAW = frozenset("script style title textarea".split())
#: Left out if they are closed; one that is not ends with its parent, and what it holds stays.
ASIDE = frozenset("noscript template iframe svg select".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label legend caption".split()
)
#: A start tag closes these if they are open above it and inside nothing of the second set.
_LISTS = frozenset("ul ol menu dir dl".split())
_ITEMS = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
_CELL = frozenset({"td", "th"})
_PARTS_OF_TABLE = {"td": (_CELL, {"tr", "table"}), "th": (_CELL, {"tr", "table"}), "tr": (_CELL | {"tr"}, {"table"})} | {k: (_CELL | {"tr", "thead", "tbody", "tfoot"}, {"table"}) for k in ("thead", "tbody", "tfoot")}
_TABLE = frozenset("table thead tbody tfoot tr td th".split())
_NO_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("td th table button caption html".split()) | ASIDE
#: A tag from its "<": names run to blanks, "/", ">" or "="; values are quoted or bare. No part is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))*+)>")
_ATTRS = re.compile(r"(?<![^\s/\"'])(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


class Node:
    """A structural element. ``pieces`` holds texts and child nodes in page order.

    ``paragraph``, ``item`` and ``part`` are the nearest element of their kind that is open here,
    itself included, or None where something stands between that a start tag does not reach through.
    """

    __slots__ = ("tag", "words", "parent", "pieces", "children", "links", "inputs", "inline", "paragraph", "item", "part")

    def __init__(self, tag: str, words: frozenset[str], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.pieces: list[str | Node] = []
        self.children: list[Node] = []
        self.links = self.inputs = self.inline = 0
        up = parent if tag not in ASIDE else None
        self.paragraph = self if tag == "p" else up.paragraph if up and tag not in _SCOPE else None
        self.item = self if tag in _ITEMS or tag in _LISTS else up.item if up else None
        self.part = self if tag in _TABLE else up.part if up else None


def attribute_words(raw: str) -> frozenset[str]:
    """Lower-case words of class, id, role and the like."""
    if "=" not in raw:
        return frozenset()
    return frozenset(w.lower() for m in _ATTRS.finditer(raw) for w in _PARTS.findall(m[2] or m[3] or m[4] or ""))


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "" or "/", name, attributes) of each piece of markup in page order; comments have no name.

    The reader may send the place to go on from, past the contents of a raw element. A tag whose
    quoted value never ends is over at the next ">"; one without any is dropped with the rest of
    the page, as browsers do.
    """
    at = page.find("<")
    while at >= 0:
        after = page[at + 1 : at + 2]
        name = closing = raw = ""
        end = 0
        if after.isascii() and after.isalpha() or after == "/" and (one := page[at + 2 : at + 3]).isascii() and one.isalpha():
            if m := _TAG.match(page, at):
                closing, name, raw, end = m[1], m[2].lower(), m[3], m.end()
            else:
                end = page.find(">", at) + 1 or len(page)
                if page[end - 1] == ">":
                    head = re.match(r"(/?)([a-zA-Z][^\s/>]*)", page[at + 1 : end])
                    closing, name, raw = head[1], head[2].lower(), page[at + 1 + head.end() : end - 1]
        elif page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                end = page.find(">", at) + 1
            else:
                over = _COMMENT_END.search(page, at + 4)
                end = over.end() if over else len(page)
        elif after in ("!", "?", "/") and after:
            end = page.find(">", at) + 1 or len(page)
        if end:
            go_on = yield at, end, closing, name, raw
            at = page.find("<", max(end, go_on or 0))
        else:
            at = page.find("<", at + 1)  # a "<" that opens nothing is text


def parse(page: str) -> Node:
    """The root node of a page; the head's contents and raw elements are left out."""
    root = Node("html", frozenset(), None)
    node, link, pos, in_head = root, 0, 0, False
    open_, reader, skip = Counter(), markup(page), None

    def leave(last: Node) -> Node:
        """Close everything from ``node`` up to ``last``; what is open then is its parent."""
        up = node
        while up is not last:
            open_[up.tag] -= 1
            up = up.parent
        open_[last.tag] -= 1
        return last.parent

    def nearest(name: str) -> Node | None:
        if not open_[name]:
            return None
        up = node
        while up.tag != name:
            up = up.parent
        return up

    def enter(name: str, words: frozenset[str] = frozenset()) -> Node:
        child = Node(name, words, node)
        node.pieces.append(child)
        node.children.append(child)
        return child

    while True:
        try:
            start, end, closing, name, raw = reader.send(skip)
        except StopIteration:
            break
        skip = None
        if start > pos:
            text = page[pos:start]
            if not in_head or not text.isspace():
                in_head = False
                node.pieces.append(text)
                node.links += len(text) * link
        pos = end
        if not name:
            continue
        if closing:
            if name == "head":
                in_head = False
            elif name == "a":
                link = 0
            elif name in ASIDE:
                if found := nearest(name):
                    node = leave(found)
                    node.pieces.pop()  # the element, which is the last there while it is open
                    node.children.pop()
            elif name in BLOCK and name not in ("html", "body"):
                if found := nearest(name):
                    node, link = leave(found), 0
                elif name == "p":
                    enter("p")
        elif name in RAW:
            if not raw.endswith("/") or name in ("script", "style"):
                over = _RAW_END[name].search(page, pos)
                pos = skip = over.end() if over else len(page)
            node.inputs += name == "textarea"
            node.pieces.append(" ")
        elif name in ASIDE:
            in_head &= name in ("noscript", "template")
            node.inputs += name == "select"
            node.pieces.append(" ")
            if not raw.endswith("/"):
                node = enter(name)
                open_[name] += 1
        elif name == "head":
            in_head = True
        elif name in ("html", "body"):
            in_head &= name == "html"
            root.words |= attribute_words(raw)
        elif name in VOID:
            in_head &= name in HEAD_VOID
            if name == "hr":
                enter("hr")
                node = leave(node.paragraph) if node.paragraph else node
            elif not in_head:
                node.inputs += name == "input"
                node.pieces.append(" " if name in ("br", "input", "img") else "")
        elif name in BLOCK:
            in_head = False
            if name in _NO_P and node.paragraph:
                node = leave(node.paragraph)
            if name in _ITEMS:
                if node.item and node.item.tag in _ITEMS[name]:
                    node = leave(node.item)
            elif name in _PARTS_OF_TABLE:
                shut, stop = _PARTS_OF_TABLE[name]
                last, part = None, node.part
                while part and part.tag not in stop:
                    last = part if part.tag in shut else last
                    part = part.parent.part
                node = leave(last) if last else node
            node, link = enter(name, attribute_words(raw)), 0
            open_[name] += 1
        else:
            in_head = False
            node.inline += 1
            if name == "a":
                link = 1
    if pos < len(page):
        node.pieces.append(page[pos:])
    return root


def clean(pieces: list[str]) -> str:
    """Text of one block: references decoded, white space one blank, trimmed."""
    text = "".join(pieces)
    return " ".join((html.unescape(text) if "&" in text else text).split())
