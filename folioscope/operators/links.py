"""The link graph: edges, resolution of titles, popularity, orphans, links across spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_key, link_target

FLAG = r"\[\[link to: ([^\]]+)\]\]"


def edges(pages: DataFrame) -> DataFrame:
    """One row ``src, space_id, pos, link, key, target`` per link, repeated links kept."""
    each = pages.select(F.col("id").alias("src"), "space_id", F.posexplode("links_list").alias("pos", "link"))
    return each.withColumns({"key": link_key(F.col("link")), "target": link_target(F.col("link"))})


def popular_links(links: DataFrame, titles: DataFrame, spaces: DataFrame, key: str | None = None, limit: int = 100) -> DataFrame:
    """Targets by number of links, with title and space alias, or id and key where these are unknown."""
    found = links if key is None else links.where(F.col("key") == key)
    top = found.groupBy("key", "target").agg(F.count("*").alias("n_links")).orderBy(F.desc("n_links"), "key", "target").limit(limit)
    named = top.join(titles.select(F.col("id").alias("target"), "title"), "target", "left").join(spaces.select(F.col("short_id").alias("key"), "alias"), "key", "left")
    return named.select("key", "target", "n_links", F.coalesce("title", "target").alias("title"), F.coalesce("alias", "key").alias("space"))


def incoming(links: DataFrame, page_id: str) -> DataFrame:
    return links.where(F.col("target") == page_id).select("src", "space_id").distinct()


def incoming_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("target").agg(F.count("*").alias("n_in"))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no page of any space links to."""
    return pages.join(links.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def orphan_share(pages: DataFrame, links: DataFrame) -> DataFrame:
    lost = orphans(pages, links).groupBy("space_id").agg(F.count("*").alias("n_orphans"))
    all_pages = pages.groupBy("space_id").agg(F.count("*").alias("n_pages"))
    n = F.coalesce("n_orphans", F.lit(0))
    return all_pages.join(lost, "space_id", "left").select("space_id", n.alias("n_orphans"), "n_pages", F.round(100.0 * n / F.col("n_pages"), 4).alias("pct"))


def cross_space(links: DataFrame, own_key: Column) -> DataFrame:
    """Per space: links within it, links out of it, and links to each target space."""
    per = links.withColumn("own", own_key).groupBy("space_id", "own", "key").agg(F.count("*").alias("n"))
    return per.groupBy("space_id").agg(
        F.sum(F.when(F.col("own") == F.col("key"), F.col("n")).otherwise(0)).alias("n_self"), F.sum(F.when(F.col("own") != F.col("key"), F.col("n")).otherwise(0)).alias("n_cross"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("by_target"),
    )


def title_index(pages: DataFrame, spaces: DataFrame) -> DataFrame:
    """``key, title, page_id``: of pages with one title in one space that with the largest id."""
    keyed = pages.join(spaces.select(F.col("id").alias("space_id"), F.col("short_id").alias("key")), "space_id")
    newest = F.max(F.struct(F.try_to_number("id", F.lit("999999999999999999")).cast("long").alias("n"), F.col("id").alias("id")))
    return keyed.groupBy("key", F.trim("title").alias("title")).agg(newest.getField("id").alias("page_id"))


def resolve_links(texts: DataFrame, index: DataFrame) -> DataFrame:
    """``id, plain_text, links_list``: link flags with titles become flags with page ids; unknown ones stay.

    Flags that already hold an id aren't titles, so a second run changes nothing.
    """
    targets = F.regexp_extract_all("plain_text", F.lit(FLAG), F.lit(1))
    pieces = F.split("plain_text", FLAG, -1)
    flat = texts.select("id", "plain_text", F.posexplode_outer(targets).alias("pos", "link"))
    key, title = link_key(F.col("link")), F.trim(link_target(F.col("link")))
    found = flat.select("id", "pos", "link", key.alias("key"), title.alias("title")).join(index, ["key", "title"], "left")
    new = F.when(F.col("page_id").isNotNull(), F.concat_ws(":", "key", "page_id")).otherwise(F.col("link"))
    by_page = found.where("pos is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("link")))).alias("links"))
    back = texts.select("id", "plain_text", pieces.alias("pieces")).join(by_page, "id", "left")
    links = F.coalesce(F.transform("links", lambda x: x["link"]), F.array().cast("array<string>"))
    rebuilt = F.concat(F.element_at("pieces", 1), F.array_join(F.transform(links, lambda x, i: F.concat(F.lit("[[link to: "), x, F.lit("]]"), F.element_at("pieces", i + 2))), ""))
    return back.select("id", F.when(F.col("plain_text").isNotNull(), rebuilt).alias("plain_text"), links.alias("links_list"))
