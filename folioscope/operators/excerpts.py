"""Lists of excerpts: which pages offer them and which show those of others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def excerpt_rows(pages: DataFrame) -> DataFrame:
    """``id, title, type, name, is_source, source_id``: a row per excerpt of each page; null lists have none."""
    return pages.select("id", "title", F.inline("excerpts"))


def excerpt_list(pages: DataFrame, sources_only: bool = False, navboxes_only: bool = False) -> DataFrame:
    """``id, title, n_excerpts, n_navboxes, n_sources, names`` of pages with any excerpt of the kind asked for."""
    rows = excerpt_rows(pages)
    if sources_only:
        rows = rows.where("is_source")
    if navboxes_only:
        rows = rows.where("type = 'navbox'")
    per = rows.groupBy("id", "title").agg(
        F.count_if(F.col("type") == "excerpt").alias("n_excerpts"), F.count_if(F.col("type") == "navbox").alias("n_navboxes"), F.count_if("is_source").alias("n_sources"),
        F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"),
    )
    return per.orderBy("id")


def merged_excerpts(*found: DataFrame) -> DataFrame:
    """``id, excerpts``: the sorted union of the sets of several tables ``id, excerpts``."""
    rows = found[0].select("id", F.explode("excerpts").alias("x"))
    for f in found[1:]:
        rows = rows.unionByName(f.select("id", F.explode("excerpts").alias("x")))
    return rows.groupBy("id").agg(F.sort_array(F.collect_set("x")).alias("excerpts"))
