"""Enrichment: a pure function of the base columns, so snapshots and deltas run the same code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dom import link_count
from ..functions.signals import LEXICAL, raw_signals, with_vectors
from ..functions.text import excerpt_name
from ..schema import BASE_COLUMNS
from ..storage import materialise
from .dom import with_facts
from .lexical import STOP_WORDS, lexical_signals, zipf_of
from .links import resolve_links, title_index
from .stats import eval_notes


def resolve_excerpts(found: DataFrame, index: DataFrame) -> DataFrame:
    """``id, excerpts``: the sources of pages, and includes resolved to their source page and its type."""
    own = found.select(F.col("id").alias("source_id"), F.inline("sources")).withColumn("name", excerpt_name(F.col("name")))
    src = own.select(F.col("source_id").alias("id"), F.struct("type", "name", F.lit(True).alias("is_source"), "source_id").alias("x"))
    each = found.select("id", F.col("key").alias("own_key"), F.inline("includes")).select("id", excerpt_name(F.col("name")).alias("name"), F.trim("title").alias("title"), F.coalesce("space_key", "own_key").alias("key"))
    placed = each.join(index, ["key", "title"]).withColumnRenamed("page_id", "source_id")
    typed = placed.join(own.groupBy("source_id", "name").agg(F.min("type").alias("type")), ["source_id", "name"], "left")
    used = typed.select("id", F.struct(F.coalesce("type", F.lit("excerpt")).alias("type"), "name", F.lit(False).alias("is_source"), "source_id").alias("x"))
    per = src.unionByName(used).groupBy("id").agg(F.sort_array(F.collect_set("x")).alias("excerpts"))
    return found.select("id").join(per, "id", "left").select("id", F.coalesce("excerpts", F.array().cast("array<struct<type:string,name:string,is_source:boolean,source_id:string>>")).alias("excerpts"))


def enrich(base: DataFrame, spaces: DataFrame, base_url: str = "https://wiki.example/", zipf: DataFrame | None = None, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """The base columns with text, counts, notes, links, excerpts and signal vectors.

    Each page is cut into nodes once; they and the facts that follow are written to the shared folder before these are
    joined with links, excerpts and lexical signals.  ``zipf(word, zipf)`` is a list of word frequencies; without one they are
    counted in the corpus itself.
    """
    keyed = base.select(*BASE_COLUMNS).join(spaces.select(F.col("id").alias("space_id"), F.col("short_id").alias("key")), "space_id", "left")
    parsed = materialise(with_facts(keyed), "parsed")
    index = title_index(base, spaces)
    links = materialise(resolve_links(parsed.select("id", F.col("dom.plain_text").alias("plain_text")), index), "links")
    excerpts = resolve_excerpts(parsed.select("id", "key", "dom.sources", "dom.includes"), index)
    texts = links.select("id", F.col("plain_text").alias("text"))
    lexical = lexical_signals(texts, materialise(zipf_of(texts), "zipf") if zipf is None else zipf, stop_words)
    rows = parsed.join(links, "id").join(excerpts, "id").join(lexical, "id")
    raw = raw_signals(F.col("html"), F.col("title"), F.col("plain_text"), F.col("dom.word_count"), F.col("child_list"), F.col("dom"), base_url, lexical={k: F.col(k) for k in LEXICAL})
    rows = with_vectors(rows, raw)
    tree = F.col("html").contains('ac:name="children"') | F.col("html").contains('ac:name="pagetree"')
    notes = eval_notes(F.col("dom.word_count"), F.col("dom.header_count"), F.col("html").contains('ac:name="toc"'), F.col("dom.lead_words"), F.col("dom.lead_links"))
    return rows.select(
        *BASE_COLUMNS, "plain_text", F.col("dom.lead_para").alias("lead_para"), F.col("dom.word_count").alias("word_count"),
        link_count(F.col("html")).alias("link_count"),
        F.regexp_count("html", F.lit("</ac:image>")).alias("image_count"), tree.alias("has_link_tree"), notes.alias("eval_notes"), "links_list", "excerpts", "raw", "scaled",
    )

