"""The markup of a page: a tokenizer that turns it into rows of elements and texts, and edits of the markup itself."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HIDDEN = ("script", "style", "template")
MACRO = "ac:structured-macro"
ROOT = "[document]"
#: Element that ``flag_links`` adds; only the plain text shows what it holds.
FLAG = "fs:flag"
#: What counts as a link in markup, and what among that does not.
LINK_MARKUP = (r"<ac:link[>\s]", r"<a\s+[^>]*href=")
MAIL_MARKUP = r"<a\s+[^>]*href\s*=\s*[\"']?mailto:"

BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table", "pre")
LISTS = ("ul", "ol")
FALLBACK, INCLUDE = "ac:adf-fallback", "excerpt-include"

_AC_LINK = re.compile(r"<ac:link\b[^>]*>.*?</ac:link>", re.DOTALL)
#: Sections of plain characters, and ampersands that may begin a reference.
_AMPERSAND = re.compile(r"<!\[CDATA\[.*?\]\s*\]\s*>|&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?", re.DOTALL)
#: Besides the nodes themselves: open elements of four kinds, the node's own among them; what an element holds, or a text says;
#: an element's heading or name, the first page reference and the lines of the first body in it, and where a table's texts begin
#: and end among those of all tables; the outermost block that a text is shown in, and the piece of its line.
DEPTHS = ("flags", "fallbacks", "tables", "lists")
HELD = ("users", "rich", "navs", "words", "pieces", "letters", "lines")
NODES = ", ".join((
    "pre int, post int, parent int, parent_tag string, tag string, attrs map<string,string>, text string", *(f"{c} int" for c in DEPTHS + HELD),
    "label string, ref int, ref_title string, ref_key string, body_lines int, table_begin int, table_end int, block int, block_tag string, line int",
))
_COLUMNS = NODES.split(", ")
_AT = {c.split()[0]: i for i, c in enumerate(_COLUMNS)}


def link_count(html: Column) -> Column:
    """Links in markup but for addresses of mail."""
    count = lambda p: F.regexp_count(html, F.lit(p))
    return count(LINK_MARKUP[0]) + count(LINK_MARKUP[1]) - count(MAIL_MARKUP)


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


def whole_references(html: str) -> str:
    """As in XML, a reference ends with a semicolon: other ampersands stand for themselves."""

    def escaped(m: re.Match) -> str:
        known = m[0][0] == "<" or m[1] and (m[1][0] == "#" or m[1] in html5)
        return m[0] if known else f"&amp;{m[1] or ''}"

    return _AMPERSAND.sub(escaped, html) if "&" in html else html


class Tokenizer(HTMLParser):
    """Rows (pre, post, parent, tag of the parent, tag, attributes, text) of one page, and the counts of ``NODES``.

    Starts, ends and texts are numbered together, so a node holds what lies between its ``pre`` and its ``post``; a
    text's are equal.  No end tag is implied: one closes up to its start tag, and is passed over if there is none.
    What is in scripts, styles and templates, and they themselves, are left out.  Counts are running ones: an element's
    are those at its end less those at its start, however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, 0, None, None, ROOT, {}, None, *[0] * len(DEPTHS + HELD), *[None] * 10]]
        self.at, self.clock, self.hidden = [0], 0, 0
        self.open: dict[str, int] = {}
        self.depth, self.held = [0] * len(DEPTHS), [0] * len(HELD)
        self.blocks = self.includes = self.in_tables = 0
        self.block: tuple[int, str] | None = None
        self.flag, self.flag_ended = 0, False
        self.said: list[str] = []
        self.refs: list[tuple] = []  # page references, parameters that name something and bodies, in order of their starts
        self.params: list[str] = []
        self.bodies: list[int] = []
        self.marks: dict[int, tuple] = {}

    def _row(self, tag: str | None, attrs: dict | None, text: str | None) -> list:
        self.clock += 1
        up = self.rows[self.at[-1]]
        row = [self.clock, self.clock, up[0], up[4], tag, attrs, text, *self.depth, *self.held, *[None] * 10]
        self.rows.append(row)
        return row

    def _shown(self, row: list, after_flag: bool = False) -> None:
        if self.blocks and not self.depth[1]:
            row[_AT["block"]], row[_AT["block_tag"]] = self.block
            row[_AT["line"]] = self.flag if self.depth[0] or after_flag else row[0]

    def _turn(self, tag: str, name: str | None, by: int) -> None:
        """Count an element as open, or no more."""
        if tag == FLAG:
            self.depth[0] += by
        elif tag == FALLBACK:
            self.depth[1] += by
        elif tag == "table":
            self.depth[2] += by
        elif tag in LISTS:
            self.depth[3] += by
        if tag in BLOCKS or name == INCLUDE:
            self.blocks += by
            self.includes += by if name == INCLUDE else 0

    def _start(self, tag: str, attrs: dict) -> None:
        name = attrs.get("ac:name") if tag == MACRO else None
        self.flag_ended = False
        self._turn(tag, name, 1)
        self.held[0] += tag == "ri:user"
        self.held[1] += tag == "ac:image" or tag == MACRO
        self.held[2] += name == "contentbylabel"
        row = self._row(tag, attrs, None)
        if tag == FLAG:
            self.flag = row[0]
        if self.blocks == 1 and (tag in BLOCKS or name == INCLUDE):
            self.block = row[0], MACRO if name == INCLUDE else tag
        if name == INCLUDE and self.includes == 1:
            self._shown(row)
        if tag == "ri:page":
            self.refs.append((row[0], attrs.get("ri:content-title"), attrs.get("ri:space-key")))
        elif tag == "ac:parameter" and attrs.get("ac:name") == "name":
            self.params.append("")
        elif tag == "ac:plain-text-body":
            self.bodies.append(0)
        if tag in ("h1", "h2", "table", "ac:parameter", "ac:plain-text-body", MACRO):
            self.marks[row[0]] = len(self.refs), len(self.params), len(self.bodies), len(self.said), self.in_tables

    def _end(self, row: list) -> None:
        self.clock += 1
        row[1] = self.clock
        tag, attrs, first = row[4], row[5], len(DEPTHS) + 7
        name = attrs.get("ac:name") if tag == MACRO else None
        self._turn(tag, name, -1)
        self.flag_ended = tag == FLAG
        row[first : first + len(HELD)] = [now - then for now, then in zip(self.held, row[first : first + len(HELD)])]
        if row[0] in self.marks:
            refs, params, bodies, said, in_tables = self.marks.pop(row[0])
            if tag == "ac:parameter" and attrs.get("ac:name") == "name":
                self.params[params - 1] = " ".join(self.said[said:])
            elif tag == "ac:plain-text-body":
                self.bodies[bodies - 1] = row[_AT["lines"]]
            elif tag == "table":
                row[_AT["table_begin"]], row[_AT["table_end"]] = in_tables, self.in_tables
            elif tag in ("h1", "h2"):
                row[_AT["label"]] = "".join(self.said[said:])
            elif tag == MACRO:
                if name in ("excerpt", INCLUDE):
                    row[_AT["label"]] = self.params[params] if params < len(self.params) and self.params[params] else "UNNAMED"
                if name == INCLUDE and refs < len(self.refs):
                    row[_AT["ref"]], row[_AT["ref_title"]], row[_AT["ref_key"]] = self.refs[refs]
                if name == "code" and bodies < len(self.bodies):
                    row[_AT["body_lines"]] = self.bodies[bodies]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return self.handle_startendtag(tag, attrs)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in HIDDEN or self.hidden:
            self.hidden += 1
            self.at.append(tag)
        else:
            self._start(tag, dict(attrs))
            self.at.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        if not self.hidden and tag not in HIDDEN:
            self._start(tag, dict(attrs))
            self._end(self.rows[-1])

    def _pop(self) -> str:
        closed = self.at.pop()
        if isinstance(closed, str):
            self.hidden -= 1
            return closed
        self._end(self.rows[closed])
        return self.rows[closed][4]

    def handle_endtag(self, tag):
        while self.open.get(tag):
            closed = self._pop()
            self.open[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        if self.hidden:
            return
        row, piece, after_flag = self._row(None, None, data), data.strip(), self.flag_ended
        self.flag_ended = False
        own = [0] * len(HELD)
        if piece and not self.depth[0]:
            own[3:] = len(piece.split()), 1, len(piece), len(piece.splitlines())
            self.held = [a + b for a, b in zip(self.held, own)]
            self.said.append(piece)
            self.in_tables += len(piece) + 1 if self.depth[2] else 0
        row[len(DEPTHS) + 7 : len(DEPTHS) + 7 + len(HELD)] = own
        if not self.includes:
            self._shown(row, after_flag)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])

    def finish(self) -> list[list]:
        self.close()
        while self.at:
            self._pop()
        return self.rows


def tokens(html: str | None, space_key: str | None) -> list[list]:
    page = Tokenizer()
    page.feed(whole_references(flag_links(html or "", space_key)))
    return page.finish()


def html_nodes(pages: DataFrame, id_col: str = "id", html_col: str = "html", key_col: str = "key") -> DataFrame:
    """``page, pre, post, parent, parent_tag, tag, attrs, text``: a row per element and text of each page, and one for its root.

    Ids are unique; a page without markup has its root alone.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html"), F.col(key_col).cast("string").alias("key"))
    kind = dict(rows.dtypes)["page"]
    names = list(_AT)
    types = [{"int": pa.int32(), "string": pa.string()}.get(x.split()[1], pa.map_(pa.string(), pa.string())) for x in _COLUMNS]

    def batch_of(page: pa.Array, at: list[int], found: list[list]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        columns[5] = [None if x is None else list(x.items()) for x in columns[5]]
        return pa.RecordBatch.from_arrays([page.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["page", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = [], [], 0
            for i, (html, key) in enumerate(zip(batch["html"], batch["key"].to_pylist(), strict=True)):
                found = tokens(html.as_py(), key)
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000]
                    held += part
                    at += [i] * len(part)
                    size += sum(len(x[6]) for x in part if x[6])
                    if len(held) >= 10_000 or size > 1 << 22:
                        yield batch_of(batch["page"], at, held)
                        at, held, size = [], [], 0
            if held:
                yield batch_of(batch["page"], at, held)

    return rows.mapInArrow(cut, f"page {kind}, {NODES}")


def strip_includes(html: Column) -> Column:
    """Without excerpt-include macros, those wrapped in a paragraph first."""
    macro = r'(?s)<ac:structured-macro[^>]*ac:name="excerpt-include"[^>]*>.*?</ac:structured-macro>'
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<p[^>]*>\s*" + macro[4:] + r"\s*</p>", ""), macro, "")


def insert_include(html: Column, page_id: Column, title: Column, name: Column, space_key: Column, source_space: Column) -> Column:
    """With an include macro before the last layout's end, else after the last paragraph; null if there is neither."""
    key = F.when(source_space.eqNullSafe(space_key), F.lit("")).otherwise(F.concat(F.lit(' ri:space-key="'), source_space, F.lit('"')))
    ident = F.substring(F.sha2(page_id, 256), 1, 16)
    macro = F.concat(
        F.lit('<p><ac:structured-macro ac:name="excerpt-include" ac:schema-version="1" ac:macro-id="'), ident, F.lit('"><ac:parameter ac:name="name">'), name,
        F.lit('</ac:parameter><ac:parameter ac:name=""><ac:link><ri:page ri:content-title="'), title, F.lit('"'), key, F.lit("/></ac:link></ac:parameter></ac:structured-macro></p>"),
    )
    out = F.lit(None).cast("string")
    for mark, after in (("</p>", True), ("</ac:layout>", False), ("</ac:layout-cell></ac:layout-section></ac:layout>", False)):
        back = F.instr(F.reverse(html), mark[::-1])
        at = F.length(html) - back - len(mark) + 2 + (len(mark) if after else 0)
        out = F.when(back > 0, F.concat(F.substr(html, F.lit(1), at - 1), macro, F.substr(html, at))).otherwise(out)
    return out
