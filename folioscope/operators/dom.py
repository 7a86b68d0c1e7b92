"""Facts of pages from their node table.

The nodes of ``html_nodes`` carry depths ("inside of") and what they hold, which the tokenizer sums up as it goes, so elements
may nest as deeply as they like and most facts are groups of narrow rows.  Only texts, lead paragraphs and cleaned markup move what pages
say.  For the last, each element becomes two events, its start and its end.

Defined results: a page without markup has no text, no units and no cells; a page's id is unique.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dom import BLOCKS, FALLBACK, FLAG, INCLUDE, LISTS, MACRO, VOID, html_nodes, link_count
from ..storage import materialise, shuffle_partitions

CELL = "ac:layout-cell"
#: What a string's blanks are: those of Unicode and the separators of ASCII.
BLANK = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_MINUTES = rf"(?<![\p{{L}}\p{{N}}_])[1-9]\p{{Nd}}{{0,2}}[{BLANK}]*+(?i:min)(?![\p{{L}}\p{{N}}_])"
#: Fixed value: the flag of a link, its space key and title.
LINK_FLAG = r"(?s)\[\[link to:\s+(?:~[A-Za-z0-9]+|[A-Z0-9]+):.*?\]\]"
_STRINGS = "array<string>"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{BLANK}]++"))


def _any(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _events(nodes: DataFrame, *more: str) -> DataFrame:
    """A row per start, end and text, with ``way`` 1, -1 and 0.

    Nodes are dealt out by page before they become events, to a stated number of tasks: what follows is work, not bytes.
    """
    own = nodes.withColumns({"name": F.when(F.col("tag") == MACRO, F.col("attrs")["ac:name"]), "piece": strip(F.col("text"))})
    place = F.when(F.col("tag").isNull(), F.array("pre")).otherwise(F.array("pre", "post"))
    own = own.select("page", "pre", "post", "parent", "parent_tag", "tag", "name", "text", "piece", *more, place.alias("place")).repartition(shuffle_partitions(nodes.sparkSession), "page")
    own = own.withColumn("pos", F.explode("place")).drop("place")
    return own.withColumn("way", F.when(F.col("tag").isNull(), 0).when(F.col("pos") == F.col("pre"), 1).otherwise(-1))


def _order() -> WindowSpec:
    return W.partitionBy("page").orderBy("pos")


def _so_far() -> WindowSpec:
    return _order().rowsBetween(W.unboundedPreceding, W.currentRow)


def _depth(condition: Column) -> Column:
    """How many elements of a kind are open after an event."""
    return F.sum(F.when(_any(condition), F.col("way")).otherwise(0)).over(_so_far())


def _total(value: Column, condition: Column) -> Column:
    return F.sum(F.when(_any(condition), value).otherwise(0)).over(_so_far())


def _elements(nodes: DataFrame) -> DataFrame:
    """A row per element with what it holds; no text is read."""
    name = F.when(F.col("tag") == MACRO, F.col("attrs")["ac:name"])
    return nodes.where("tag is not null").withColumn("name", name).drop("attrs", "text")


def _listed(condition: Column, *values: Column) -> Column:
    """The values of the rows that hold ``condition``, as an array in document order."""
    return F.sort_array(F.collect_list(F.when(_any(condition), F.struct("pre", *values))))


def _element_facts(elements: DataFrame) -> DataFrame:
    cell = F.col("words") - F.greatest(F.col("pieces") - 1, F.lit(0)) + F.col("users")
    source, include, heads = F.col("name") == "excerpt", (F.col("name") == INCLUDE) & F.col("ref").isNotNull(), F.col("tag").isin("h1", "h2")
    label = F.col("label").alias("label")
    return elements.groupBy("page").agg(
        F.count_if(_any(heads)).cast("int").alias("header_count"), F.array_join(F.transform(_listed(heads, label), lambda x: x["label"]), ",").alias("header_titles"),
        F.count_if(_any((F.col("tag") == "ac:image") & (F.col("tables") == 0))).cast("int").alias("images_outside_tables"), F.count_if(_any((F.col("name") == "drawio") & (F.col("tables") == 0))).cast("int").alias("diagrams_outside_tables"),
        F.transform(_listed(F.col("tag") == "td", cell.cast("int").alias("n")), lambda x: x["n"]).alias("cells"),
        F.count_if(_any(F.col("name") == "code")).cast("int").alias("code_blocks"), F.coalesce(F.sum("body_lines"), F.lit(0)).cast("int").alias("code_lines"),
        F.transform(_listed(source, F.when(F.col("navs") > 0, "navbox").otherwise("excerpt").alias("type"), label), lambda x: F.struct(x["type"].alias("type"), x["label"].alias("name"))).alias("sources"),
        F.transform(_listed(include, label, F.col("ref_title").alias("title"), F.col("ref_key").alias("key")), lambda x: F.struct(x["label"].alias("name"), x["title"].alias("title"), x["key"].alias("space_key"))).alias("includes"),
    )


def _words_outside(nodes: DataFrame) -> DataFrame:
    return nodes.where("tag is null and tables = 0").groupBy("page").agg(F.sum("words").cast("int").alias("words_outside_tables"))


def _table_texts(nodes: DataFrame) -> DataFrame:
    """``page, joined``: what is said in a page's tables, joined by blanks."""
    said = nodes.where("tag is null and tables > 0 and pieces > 0").select("page", "pre", strip(F.col("text")).alias("piece"))
    return said.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "piece"))), lambda x: x["piece"]), " ").alias("joined"))


def _minutes(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """``page, minutes_in_tables``: for each table the durations that stand wholly in it, so one in nested tables counts for each.

    Matches and the edges of tables are merged by their place in the text of all tables.
    """
    tables = elements.where("tag = 'table'").select("page", "pre", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("table_begin").alias("off")), F.struct(F.lit(1).alias("end"), F.col("table_end").alias("off")))).alias("e"))
    blank = lambda kind: F.lit(None).cast(kind)
    edges = tables.select("page", "pre", F.col("e.end").alias("end"), F.col("e.off").alias("off"), F.lit(0).alias("hit"), blank("long").alias("upto"))
    text = texts.where(F.col("joined").rlike(_MINUTES))
    hits = text.select("page", F.posexplode(F.arrays_zip(F.regexp_extract_all("joined", F.lit(_MINUTES), F.lit(0)).alias("hit"), F.split("joined", _MINUTES, -1).alias("between"))).alias("i", "x")).where("x.hit is not null")
    upto = F.sum(F.length("x.hit") + F.length("x.between")).over(W.partitionBy("page").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    hits = hits.select("page", F.length("x.hit").alias("n"), upto.cast("long").alias("upto")).select("page", blank("int").alias("pre"), blank("int").alias("end"), (F.col("upto") - F.col("n")).alias("off"), F.lit(1).alias("hit"), "upto")
    order = W.partitionBy("page").orderBy("off", "hit").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = edges.unionByName(hits).withColumns({"before": F.sum("hit").over(order), "last": F.last("upto", ignorenulls=True).over(order)}).where("hit = 0")
    of = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c)))
    per = seen.groupBy("page", "pre").agg((of(1, "before") - of(0, "before")).alias("n"), (of(1, "last") >= of(1, "off")).alias("cut"))
    return per.groupBy("page").agg(F.sum(F.col("n") - F.when((F.col("n") > 0) & F.col("cut"), 1).otherwise(0)).cast("int").alias("minutes_in_tables"))


def _units(elements: DataFrame) -> DataFrame:
    """``page, paragraphs, lead_words, first, last, cell``: words of each prose unit, and where the first one lies.

    Units are made of the direct children of layout cells, or of the page if it has none: a paragraph that says something
    with the lists that follow it at once, or a list with text that follows no such paragraph.  Nothing in a fallback is prose.
    """
    has_cells = F.max((F.col("tag") == CELL).cast("int")).over(W.partitionBy("page"))
    rows = elements.where((F.col("parent_tag") == CELL) | (F.col("parent") == 0) | (F.col("tag") == CELL))
    rows = rows.select("page", "pre", "post", "parent", "parent_tag", "tag", "fallbacks", "lists", "words", "pieces", "rich").withColumn("has_cells", has_cells).where(((F.col("parent_tag") == CELL) | ((F.col("has_cells") == 0) & (F.col("parent") == 0))) & (F.col("tag") != FLAG))
    listed, run = F.col("tag").isin(*LISTS), F.col("words") - F.greatest(F.col("pieces") - 1, F.lit(0))
    outside = (F.col("fallbacks") - (F.col("tag") == FALLBACK).cast("int")) == 0
    # a paragraph counts by the words of its texts joined without blanks
    good = (F.col("tag") == "p") & (F.col("lists") == 0) & ((run >= 5) | ((run >= 2) & (F.col("rich") == 0)))
    before = W.partitionBy("page", "parent").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    lead = F.last(F.when(~listed, F.struct(F.col("pre"), good.alias("good"))), ignorenulls=True).over(before)
    rows = rows.where(outside).withColumn("lead", lead)
    unit = F.when(listed, F.when(_any(F.col("lead.good")), F.col("lead.pre")).when(F.col("pieces") > 0, F.col("pre"))).otherwise(F.when(good, F.col("pre")))
    units = rows.withColumn("unit", unit).where("unit is not null").groupBy("page", "parent", "unit").agg(F.sum("words").cast("int").alias("n"), F.min("pre").alias("first"), F.max("post").alias("last"))
    each = F.sort_array(F.collect_list(F.struct("parent", "unit", "n", "first", "last")))
    return units.groupBy("page").agg(each.alias("u")).select("page", F.transform("u", lambda x: x["n"]).alias("paragraphs"), F.col("u")[0]["n"].alias("lead_words"), F.col("u")[0]["first"].alias("first"), F.col("u")[0]["last"].alias("last"), F.col("u")[0]["parent"].alias("cell"))


def _escaped(text: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _markup() -> Column:
    """An event as markup."""
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(F.coalesce(e["value"], F.lit("")), True), F.lit('"'))), "")
    void = F.col("tag").isin(*VOID)
    start = F.concat(F.lit("<"), F.col("tag"), attrs, F.when(void, "/>").otherwise(">"))
    return F.when(F.col("way") == 0, _escaped(F.col("text"))).when(F.col("way") == 1, start).otherwise(F.when(void, "").otherwise(F.concat(F.lit("</"), F.col("tag"), F.lit(">"))))


def _in_order(value: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos"), value.alias("x")))), lambda y: y["x"]), "")


def _lead(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """``page, lead_para``: markup of the first unit.  Between its paragraph and its lists stand texts of the cell alone."""
    inside = "pre between first and last and flags = 0 and not (tag is null and parent = cell)"
    own = nodes.join(units.select("page", "first", "last", "cell").hint("shuffle_hash"), "page").where(inside).select("page", "pre", "post", "tag", "attrs", "text")
    own = own.select("*", F.explode(F.when(F.col("tag").isNull(), F.array("pre")).otherwise(F.array("pre", "post"))).alias("pos"))
    own = own.withColumn("way", F.when(F.col("tag").isNull(), 0).when(F.col("pos") == F.col("pre"), 1).otherwise(-1))
    return own.groupBy("page").agg(_in_order(_markup()).alias("lead_para"))


def _mark(title: Column, found: Column) -> Column:
    return F.concat(F.lit("[[Excerpt from: "), F.when(_any(found), F.coalesce(title, F.lit("Unknown page"))).otherwise("Unknown page"), F.lit("]]"))


def _named_includes(nodes: DataFrame) -> DataFrame:
    """Nodes with ``mark``: what an included excerpt is shown as."""
    back = W.partitionBy("page").orderBy(F.desc("pre")).rowsBetween(W.unboundedPreceding, -1)
    ref = F.last(F.when(F.col("tag") == "ri:page", F.struct("pre", F.col("attrs")["ri:content-title"].alias("title"))), ignorenulls=True).over(back)
    rows = nodes.withColumn("ref", ref)
    include = (F.col("tag") == MACRO) & (F.col("attrs")["ac:name"] == INCLUDE)
    return rows.withColumn("mark", F.when(include, _mark(F.col("ref.title"), F.col("ref.pre") < F.col("post")))).drop("ref")


def plain_text(nodes: DataFrame, found_only: bool = False) -> DataFrame:
    """``page, plain_text, word_count``: a line per outermost block, each line once, and the words in them without flags.

    Of every page, or with ``found_only`` of those that show anything.
    """
    after_flag = (F.col("line") != F.col("pre")) & (F.col("flags") == 0)
    shown = F.when(F.col("tag").isNotNull(), _mark(F.col("ref_title"), F.col("ref").isNotNull())).when(after_flag, F.col("text")).otherwise(strip(F.col("text")))
    rows = nodes.where("block is not null").select("page", F.struct(F.col("block").alias("pos"), F.col("block_tag").alias("tag")).alias("block"), F.col("line").alias("group"), F.col("pre").alias("pos"), shown.alias("shown"))
    rows = rows.repartition(shuffle_partitions(nodes.sparkSession), "page")
    pieces = rows.groupBy("page", "block", "group").agg(strip(_in_order(F.col("shown"))).alias("shown")).where("shown <> ''")  # a flag and the text after it are one
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "shown"))), lambda x: x["shown"]), " ")
    lines = pieces.groupBy("page", "block").agg(joined.alias("text"))
    tag, text = F.col("block.tag"), F.col("text")
    line = F.when(tag.isin("h1", "h2"), F.concat(F.lit("[[Heading: "), text, F.lit("]]"))).when(tag == "li", F.concat(F.lit("- "), text)).otherwise(text)
    once = lines.withColumn("line", strip(line)).groupBy("page", "line").agg(F.min(F.struct(F.col("block.pos").alias("pos"), text.alias("text"))).alias("x"))
    words = F.sum(n_words(F.regexp_replace("x.text", LINK_FLAG, ""))).cast("int")
    found = once.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x.pos", "line"))), lambda y: y["line"]), "\n").alias("plain_text"), words.alias("word_count"))
    if found_only:
        return found
    return nodes.where("pre = 0 and tag = '[document]'").select("page").join(found, "page", "left").na.fill({"plain_text": "", "word_count": 0})


def clean_html(nodes: DataFrame) -> DataFrame:
    """``page, html``: markup without fallbacks, with a paragraph for each included excerpt, and without elements that show no text."""
    rows = _events(_named_includes(nodes), "attrs", "mark")
    rows = rows.withColumns({"fallbacks": _depth(F.col("tag") == FALLBACK), "includes": _depth(F.col("name") == INCLUDE), "flags": _depth(F.col("tag") == FLAG)})
    inner = (F.col("includes") - F.when(F.col("way") == 1, _any(F.col("name") == INCLUDE).cast("int")).otherwise(0)) > 0
    shown = ((F.col("way") == 0) & (F.col("piece") != "")) | ((F.col("way") == 1) & (F.col("name") == INCLUDE))
    rows = rows.where((F.col("fallbacks") == 0) & ~_any(F.col("tag") == FALLBACK) & (F.col("flags") == 0) & ~_any(F.col("tag") == FLAG)).withColumn("seen", _total(F.lit(1), shown & ~inner))
    edge = W.partitionBy("page", "pre")
    texts = rows.withColumn("held", F.max("seen").over(edge) - F.min("seen").over(edge))  # of an element: after its end and after its start
    keep = (F.col("way") == 0) | (F.col("held") > 0)
    value = F.when(F.col("mark").isNotNull(), F.when(F.col("way") == 1, F.concat(F.lit("<p>"), _escaped(F.col("mark")), F.lit("</p>"))).otherwise("")).when(keep, _markup()).otherwise("")
    visible = texts.where((~inner | F.col("mark").isNotNull()) & ~((F.col("includes") > 0) & F.col("mark").isNull()) & ~(inner & F.col("mark").isNotNull()) & (F.col("pre") > 0))
    # a blank text stays where its parent does
    parents = texts.where("way = 1").select("page", F.col("pre").alias("parent"), (F.col("held") > 0).alias("parent_stays"))
    stays = visible.join(parents, ["page", "parent"], "left").where((F.col("way") != 0) | (F.col("parent") == 0) | _any(F.col("parent_stays")))
    out = stays.groupBy("page").agg(_in_order(value).alias("html"))
    return nodes.where("pre = 0 and tag = '[document]'").select("page").join(out, "page", "left").na.fill({"html": ""})


def page_facts(nodes: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Facts of each page, a row per page: all, or those named.  ``nodes`` is read several times, so it should be a written table.

    Each kind of facts is one pass over the nodes it needs; kinds that are not asked for are not made.
    """
    elements = _elements(nodes)
    units = _units(elements)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kinds = [
        (lambda: plain_text(nodes, True), {"plain_text": F.coalesce("plain_text", F.lit("")).alias("plain_text"), "word_count": zero("word_count")}),
        (lambda: _lead(nodes, units), {"lead_para": F.col("lead_para"), "lead_links": F.coalesce(link_count(F.col("lead_para")), F.lit(0)).alias("lead_links")}),
        (lambda: units.select("page", "paragraphs", "lead_words"), {"lead_words": zero("lead_words"), "paragraphs": F.coalesce("paragraphs", F.array().cast("array<int>")).alias("paragraphs")}),
        (lambda: _minutes(elements, _table_texts(nodes)), {"minutes_in_tables": zero("minutes_in_tables")}),
        (lambda: _words_outside(nodes), {"words_outside_tables": zero("words_outside_tables")}),
        (lambda: _element_facts(elements), {c: F.col(c) for c in ("header_count", "header_titles", "images_outside_tables", "diagrams_outside_tables", "cells", "code_blocks", "code_lines", "sources", "includes")}),
    ]
    wanted = list(only or (c for _, columns in kinds for c in columns))
    rows, found = nodes.where("pre = 0 and tag = '[document]'").select("page"), {}
    for kind, columns in kinds:
        if not columns.keys().isdisjoint(wanted):
            rows, found = rows.join(kind(), "page", "left"), found | columns
    return rows.select("page", *(found[c] for c in wanted))


def with_facts(pages: DataFrame, id_col: str = "id", html_col: str = "html", key_col: str = "key", out: str = "dom", only: Iterable[str] | None = None) -> DataFrame:
    """``pages`` with a struct of all facts, or of those named.  Markup is cut into nodes once, and they are written to the shared folder."""
    nodes = materialise(html_nodes(pages, id_col, html_col, key_col), "nodes")
    found = page_facts(nodes, only)
    found = found.select(F.col("page").alias(id_col), F.struct(*(c for c in found.columns if c != "page")).alias(out))
    return pages.repartition(shuffle_partitions(pages.sparkSession), id_col).join(found, id_col)
