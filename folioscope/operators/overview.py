"""The quality overview of spaces and corpus, and the comparison of two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import share
from ..schema import ADMIN_TYPES
from .links import orphans

#: Goals of the metrics, in percent.
GOALS = {
    "non_dead_ends_share": 90, "non_orphans_share": 60, "link_density": 3, "lead_paras_good_share": 15, "excerpts_and_reuse_share": 10, "non_junk_pages_share": 95,
    "landing_page_coverage": 5, "navbox_coverage": 20, "hub_coverage": 20,
}
METRICS = ("total_pages", "total_words", "content_pages", "content_words", *GOALS)


def content_pages(pages: DataFrame) -> DataFrame:
    """Without administrative types, and without pages that have none."""
    return pages.where(~F.col("page_type").isin(*ADMIN_TYPES))


def space_overview(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row per space and one (``space_id`` null) for the corpus: grouping sets over one scan.

    ``pages`` has native arrays; the orphans come from one anti-join and join as one row per page.
    """
    lost = orphans(content_pages(pages).select("id"), links).withColumn("orphan", F.lit(True))
    content = ~F.col("page_type").isin(*ADMIN_TYPES)
    n = lambda c: F.count_if(content & c)
    excerpt = lambda kind: F.exists("excerpts", lambda x: x["type"] == kind)
    rows = pages.select(
        "id", "space_id", "page_type", "word_count", "link_count", excerpt("excerpt").alias("reuse"), excerpt("navbox").alias("navbox"),
        F.array_contains("eval_notes", "lead-para-good").alias("lead"), (F.size("duplicate_list") > 0).alias("dup"),
    ).join(lost, "id", "left")
    c = {
        "content_pages": F.count_if(content), "dead": n(F.col("link_count") == 0), "lost": n(F.coalesce("orphan", F.lit(False))), "leads": n(F.col("lead")), "reused": n(F.col("reuse")),
        "dups": n(F.col("dup")), "empty": n(F.col("word_count") < 25), "landing": n(F.col("page_type") == "landing_page"), "navboxes": n(F.col("navbox")), "hubs": n(F.col("page_type") == "canonical_intro"),
    }
    sums = rows.rollup("space_id").agg(
        F.grouping("space_id").alias("whole"), F.count("*").alias("total_pages"), F.sum("word_count").alias("total_words"),
        F.sum(F.when(content, F.col("word_count"))).alias("content_words"), F.sum(F.when(content, F.col("link_count"))).alias("links"), *(v.alias(k) for k, v in c.items()),
    )
    part = lambda x: F.round(share(F.col(x), F.col("content_pages")), 4)
    rest = lambda x: F.round(1 - share(x, F.col("content_pages")), 4)
    return sums.select(
        F.when(F.col("whole") == 1, "*").otherwise(F.col("space_id")).alias("space_id"), "total_pages", "total_words", "content_pages", "content_words",
        rest(F.col("dead")).alias("non_dead_ends_share"), rest(F.col("lost")).alias("non_orphans_share"), F.round(share(F.col("links"), F.col("content_words")), 4).alias("link_density"),
        part("leads").alias("lead_paras_good_share"), part("reused").alias("excerpts_and_reuse_share"), rest(F.col("dups") + F.col("empty")).alias("non_junk_pages_share"),
        part("landing").alias("landing_page_coverage"), part("navboxes").alias("navbox_coverage"), part("hubs").alias("hub_coverage"),
    )


def type_breakdown(pages: DataFrame, types: list[str]) -> DataFrame:
    """Pages of each type per space, one column a type."""
    return pages.groupBy("space_id").agg(*(F.count_if(F.col("page_type") == t).alias(t) for t in types))


def compare_overviews(old: DataFrame, new: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``space_id, status, metric, old, new, delta``; spaces of one side only have one row without a metric."""
    missing = [m for m in metrics if m not in old.columns or m not in new.columns]
    if missing:
        raise ValueError(f"metrics on one side only: {missing}")
    pick = lambda df, tag: df.select("space_id", F.lit(True).alias(f"in_{tag}"), *(F.col(m).cast("double").alias(f"{tag}_{m}") for m in metrics))
    both = pick(old, "old").join(pick(new, "new"), "space_id", "full_outer")
    status: Column = F.when(F.col("in_old") & F.col("in_new"), "matched").when(F.col("in_old"), "only_old").otherwise("only_new")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"old_{m}").alias("old"), F.col(f"new_{m}").alias("new")) for m in metrics))
    rows = both.select("space_id", status.alias("status"), F.inline(each))
    matched = rows.where("status = 'matched' and old is not null").withColumn("delta", F.col("new") - F.col("old"))
    single = both.where(status != "matched").select("space_id", status.alias("status"), F.lit(None).cast("string").alias("metric"), *(F.lit(None).cast("double").alias(k) for k in ("old", "new", "delta")))
    return matched.unionByName(single)
