"""The facts of a page by a walk over its element tree, page by page: what the node tables are held against.

Nothing here recurses, so a page may nest as deeply as it likes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table", "pre"}
LISTS = {"ul", "ol"}
CELL, FALLBACK, MACRO, WIKI_LINK = "ac:layout-cell", "ac:adf-fallback", "ac:structured-macro", "ac:link"
LINK_FLAG = re.compile(r"\[\[link to:\s+(~[A-Za-z0-9]+|[A-Z0-9]+):(.*?)\]\]", re.DOTALL)


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent, self.children = name, attrs or {}, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below this one, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))

    def find_all(self, *names: str) -> list[Node]:
        return [x for x in self.walk() if x.name in names]

    def strings(self, without: frozenset[str] | set[str] = frozenset(HIDDEN)) -> Iterator[str]:
        """Visible text in document order, but for what is in elements named ``without``."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in without:
                stack.extend(reversed(x.children))

    def text(self, separator: str = " ", without: frozenset[str] | set[str] = frozenset(HIDDEN)) -> str:
        return separator.join(s for s in (x.strip() for x in self.strings(without)) if s)

    def words(self) -> list[str]:
        return self.text().split()

    def inside(self, names: set[str]) -> bool:
        at = self.parent
        while at is not None:
            if at.name in names:
                return True
            at = at.parent
        return False

    def html(self) -> str:
        """Markup of this element."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x.name in HIDDEN:
                continue
            attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in x.attrs.items())
            if x.name in VOID:
                out.append(f"<{x.name}{attrs}/>")
                continue
            out.append(f"<{x.name}{attrs}>")
            stack.append(f"</{x.name}>")
            stack.extend(escape(c, False) if isinstance(c, str) else c for c in reversed(x.children))
        return "".join(out)


class _Tree(HTMLParser):
    """No implied end tags; an end tag closes up to its start tag, and an unmatched one is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            closed, self.at = self.at, self.at.parent
            self.open[closed.name] -= 1
            if closed.name == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.at.children.append(data[6:])


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


_AC_LINK = re.compile(r"<ac:link\b[^>]*>.*?</ac:link>", re.DOTALL)
#: Element that ``flag_links`` adds; only the plain text shows what it holds.
FLAG = "fs:flag"


def flag_links(html: str, space_key: str | None) -> str:
    """After each wiki link with a title a readable flag with its space and title, in an element of its own."""

    def flagged(m: re.Match) -> str:
        title = re.search(r'ri:content-title="([^"]+)"', m[0])
        if not title:
            return m[0]
        space = re.search(r'ri:space-key="([^"]+)"', m[0])
        key = space[1] if space else space_key
        return f"{m[0]}<{FLAG}>[[link to: {key + ':' if key else ''}{title[1]}]]</{FLAG}>"

    return _AC_LINK.sub(flagged, html)


#: What holds no text of the page itself.
_NO_FLAGS = frozenset({*HIDDEN, FLAG})


def _macro(node: Node) -> str | None:
    return node.attrs.get("ac:name") if node.name == MACRO else None


def _excerpt_mark(node: Node) -> str:
    page = next((x for x in node.walk() if x.name == "ri:page"), None)
    title = page.attrs.get("ri:content-title", "Unknown page") if page else "Unknown page"
    return f"[[Excerpt from: {title}]]"


def _shown(block: Node) -> str:
    """Text of a block as displayed: fallbacks left out, included excerpts named, link flags kept."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(block.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x.strip())
        elif _macro(x) == "excerpt-include":
            out.append(_excerpt_mark(x))
        elif x.name == FLAG:  # what follows a flag at once is one text with it
            out.append((x.text("") + (stack.pop() if x.parent.children[-1] is not x and isinstance(stack[-1], str) else "")).strip())
        elif x.name not in HIDDEN and x.name != FALLBACK:
            stack.extend(reversed(x.children))
    return " ".join(x for x in out if x)


def clean_html(html: str) -> str:
    """Markup without fallbacks, with a paragraph for each included excerpt, and without elements that show no text."""
    root = parse(html)
    order = [root, *root.walk()]
    marks = {id(x): _excerpt_mark(x) for x in order if _macro(x) == "excerpt-include"}
    for x in reversed(order):  # what is inside comes before what it is in
        kept: list[Node | str] = []
        for c in x.children:
            if isinstance(c, Node) and _macro(c) == "excerpt-include":
                mark = Node("p", {}, x)
                mark.children.append(marks[id(c)])
                c = mark
            if isinstance(c, str) or (c.name != FALLBACK and c.name not in HIDDEN and any(not isinstance(y, str) or y.strip() for y in c.children)):
                kept.append(c)
        if _macro(x) != "excerpt-include":
            x.children = kept
    return "".join(escape(c, False) if isinstance(c, str) else c.html() for c in root.children)


def _blocks(root: Node) -> Iterator[tuple[str, Node]]:
    """Outermost blocks, and included excerpts outside of them, in document order."""
    stack = [c for c in reversed(root.children) if isinstance(c, Node)]
    while stack:
        x = stack.pop()
        if x.name == FALLBACK:
            continue
        if x.name in BLOCKS or _macro(x) == "excerpt-include":
            yield x.name, x
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def _plain_text(root: Node) -> tuple[str, int]:
    """Display text, a line per outermost block and each line once, and the words in it without flags."""
    lines: dict[str, str] = {}
    for name, block in _blocks(root):
        text = _excerpt_mark(block) if name == MACRO else _shown(block)
        if not text:  # a block without visible text, which includes all that its tags hold, is no line
            continue
        shown = f"[[Heading: {text}]]" if name in ("h1", "h2") else f"- {text}" if name == "li" else text
        lines.setdefault(shown.strip(), text)
    return "\n".join(lines), sum(len(LINK_FLAG.sub("", t).split()) for t in lines.values())


def plain_text(html: str, space_key: str | None) -> tuple[str, int]:
    return _plain_text(parse(flag_links(html, space_key))) if html else ("", 0)


def _prose(root: Node) -> Iterator[list[Node]]:
    """Units of prose among the direct children of layout cells, or of the page if it has none.

    A unit is a paragraph that says something with the lists that follow it at once, or a list with text that
    follows no such paragraph.  Nothing inside a fallback is prose.
    """
    cells = [c for c in root.find_all(CELL)] or [root]
    for cell in cells:
        if cell.name == FALLBACK or cell.inside({FALLBACK}):
            continue
        nested = cell.inside(LISTS)
        unit: list[Node] = []
        for x in cell.children:
            if not isinstance(x, Node) or x.name == FLAG:
                continue
            if x.name in LISTS and unit and unit[0].name == "p":
                unit.append(x)
                continue
            if unit:
                yield unit
            unit = []
            if x.name in LISTS:
                unit = [x] if x.text("", _NO_FLAGS) else []
                if unit:
                    yield unit
                unit = []
            elif x.name == "p" and not nested:
                n = len(x.text("", _NO_FLAGS).split())
                if n >= 5 or (n >= 2 and not any(y.name in ("ac:image", MACRO) for y in x.walk())):
                    unit = [x]
        if unit:
            yield unit


def link_count(html: str) -> int:
    return len(re.findall(r"<ac:link[>\s]", html)) + len(re.findall(r"<a\s+[^>]*href=", html)) - len(re.findall(r"<a\s+[^>]*href\s*=\s*[\"']?mailto:", html))


_MINUTES = re.compile(r"\b[1-9]\d{0,2}\s*min\b", re.IGNORECASE)
FACTS = (
    "plain_text string, word_count int, lead_para string, lead_words int, lead_links int, paragraphs array<int>, header_count int, header_titles string, minutes_in_tables int, "
    "words_outside_tables int, images_outside_tables int, diagrams_outside_tables int, cells array<int>, code_blocks int, code_lines int, "
    "sources array<struct<type:string,name:string>>, includes array<struct<name:string,title:string,space_key:string>>"
)


def _words(x: Node) -> int:
    return len(x.text(" ", _NO_FLAGS).split())


class _Sums:
    """Running sums over a tree in document order, so that what an element holds is a difference of two.

    Elements may nest in one another without an end, so their texts are not gathered one by one.
    """

    def __init__(self, root: Node):
        self.users, self.words = [0], [0]
        self.nodes: dict[int, list[int]] = {}
        self.outside_words = self.outside_images = self.outside_diagrams = 0
        texts: list[str] = []
        tables = hidden = 0
        stack: list[tuple[Node | str, bool]] = [(root, False)]
        while stack:
            x, closing = stack.pop()
            if isinstance(x, str):
                text = x.strip()
                if text and not hidden:
                    n = len(text.split())
                    texts.append(text)
                    self.words.append(self.words[-1] + n)
                    self.outside_words += 0 if tables else n
            elif closing:
                self.nodes[id(x)][2:] = [len(texts), len(self.users) - 1]
                tables -= x.name == "table"
                hidden -= x.name in _NO_FLAGS
            else:
                self.nodes[id(x)] = [len(texts), len(self.users) - 1, 0, 0]
                tables += x.name == "table"
                hidden += x.name in _NO_FLAGS
                self.users.append(self.users[-1] + (x.name == "ri:user"))
                if not tables:
                    self.outside_images += x.name == "ac:image"
                    self.outside_diagrams += _macro(x) == "drawio"
                stack.append((x, True))
                stack.extend((c, False) for c in reversed(x.children))
        joined, begin = " ".join(texts), [0]
        for t in texts:
            begin.append(begin[-1] + len(t) + 1)
        self.begin, self.found = begin, [m.span() for m in _MINUTES.finditer(joined)]
        self.first = [a for a, _ in self.found]

    def cell(self, x: Node) -> int:
        """Words of a cell, whose strings are joined without a blank, and mentions in it."""
        a, u, b, v = self.nodes[id(x)]
        return self.words[b] - self.words[a] - max(b - a - 1, 0) + self.users[v] - self.users[u]

    def minutes_in(self, x: Node) -> int:
        a, _, b, _ = self.nodes[id(x)]
        low, high = bisect_left(self.first, self.begin[a]), bisect_left(self.first, self.begin[b])
        return high - low - (high > low and self.found[high - 1][1] >= self.begin[b])


def facts(html: str | None, space_key: str | None) -> dict:
    """All facts of a page from one parse, of the markup with link flags."""
    root = parse(flag_links(html or "", space_key))
    text, words = _plain_text(root) if html else ("", 0)
    units = list(_prose(root))
    lead = _without_flags("".join(x.html() for x in units[0])) if units else None
    by_name: dict[str, list[Node]] = {}
    for x in root.walk():
        by_name.setdefault(x.name, []).append(x)
    tables, macros = by_name.get("table", []), by_name.get(MACRO, [])
    sums = _Sums(root)
    code = [m for m in macros if _macro(m) == "code"]
    bodies = [b[0].text("\n", _NO_FLAGS) for b in (m.find_all("ac:plain-text-body") for m in code) if b]
    param = lambda m: next((p.text(" ", _NO_FLAGS) for p in m.find_all("ac:parameter") if p.attrs.get("ac:name") == "name"), None)
    sources = [{"type": "navbox" if any(_macro(x) == "contentbylabel" for x in m.find_all(MACRO)) else "excerpt", "name": param(m) or "UNNAMED"} for m in macros if _macro(m) == "excerpt"]
    includes = []
    for m in macros:
        page = m.find_all("ri:page") if _macro(m) == "excerpt-include" else []
        if page:
            includes.append({"name": param(m) or "UNNAMED", "title": page[0].attrs.get("ri:content-title"), "space_key": page[0].attrs.get("ri:space-key")})
    headers = root.find_all("h1", "h2")
    return {
        "plain_text": text, "word_count": words, "lead_para": lead, "lead_words": sum(map(_words, units[0])) if units else 0, "lead_links": link_count(lead) if lead else 0,
        "paragraphs": [sum(map(_words, u)) for u in units], "header_count": len(headers), "header_titles": ",".join(h.text("", _NO_FLAGS) for h in headers),
        "minutes_in_tables": sum(map(sums.minutes_in, tables)),
        "words_outside_tables": sums.outside_words, "images_outside_tables": sums.outside_images, "diagrams_outside_tables": sums.outside_diagrams,
        "cells": [sums.cell(c) for c in by_name.get("td", [])], "code_blocks": len(code), "code_lines": sum(len(b.splitlines()) for b in bodies), "sources": sources, "includes": includes,
    }


_FLAG_MARKUP = re.compile(f"<{FLAG}>.*?</{FLAG}>", re.DOTALL)


def _without_flags(html: str) -> str:
    return _FLAG_MARKUP.sub("", html)
