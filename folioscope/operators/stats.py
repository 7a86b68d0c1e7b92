"""Statistics of pages, authors and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squash_runs
from ..schema import LONG_PAGE_WORDS, STUB_WORDS, TOC_WORDS
from ..storage import materialise, shuffle_partitions


def blank_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("word_count") == 0) & (F.length("html") < 50))


def wordless_pages(pages: DataFrame) -> DataFrame:
    """Without words, and without a code block of several lines."""
    code = F.regexp_extract("html", r'(?s)ac:name=["\']code["\'].*?<ac:plain-text-body>(.*?)</ac:plain-text-body>', 1)
    return pages.where((F.col("word_count") == 0) & ~code.contains("\n"))


def stubs(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("word_count") > 0) & (F.col("word_count") < STUB_WORDS))


def structural_value(children: Column, tree: Column, links: Column, least: int = 0) -> Column:
    """``least``: more children than that count as structure."""
    some = F.coalesce(F.size(children), F.lit(0)) > least
    return F.when(tree & some & (links > 5), "landing page").when(tree, "has child-macro").when(some, "candidate").otherwise("-")


def stale(pages: DataFrame, today: Column, days: int) -> DataFrame:
    return pages.where(F.datediff(today, F.to_date(F.substring("last_modified", 1, 10))) >= days)


def eval_notes(words: Column, headers: Column, has_toc: Column, lead_words: Column, lead_links: Column, strict_headers: bool = False) -> Column:
    """Flags of a page.  Unless ``strict_headers``, any page with a header and a word, or a long one, has too few."""
    few = ((headers == 0) & (words > 500)) | (words > TOC_WORDS) & (headers < 3) if strict_headers else ((headers > 0) & (words > 0)) | (words > TOC_WORDS)
    flags = {"page-too-long": words > LONG_PAGE_WORDS, "headers-too-few": few, "toc-missing": (words > TOC_WORDS) & ~has_toc, "lead-para-good": (lead_words > 20) & (lead_links > 3)}
    return F.filter(F.array(*(F.when(v, k) for k, v in flags.items())), lambda x: x.isNotNull())


def top_authors(pages: DataFrame, limit: int = 100) -> DataFrame:
    """By number of entries in the squashed edit histories."""
    return pages.select(F.explode("authors").alias("author")).groupBy("author").agg(F.count("*").alias("n_edits")).orderBy(F.desc("n_edits"), "author").limit(limit)


def author_history(versions: DataFrame, authors: DataFrame) -> DataFrame:
    """``id, authors``: per page the author names in order, long runs squashed; unknown authors keep their id."""
    ids = versions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "author_id"))).alias("v")).select("id", squash_runs(F.transform("v", lambda x: x["author_id"])).alias("ids"))
    named = ids.select("id", F.posexplode("ids").alias("pos", "author_id")).join(authors.select("author_id", "name_normalized"), "author_id", "left")
    return named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name_normalized", "author_id").alias("a")))), lambda x: x["a"]).alias("authors"))


def label_counts(pages: DataFrame, limit: int | None = None) -> DataFrame:
    out = pages.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n_pages")).orderBy(F.desc("n_pages"), "label")
    return out if limit is None else out.limit(limit)


def label_mentions(pages: DataFrame, label: str) -> DataFrame:
    """Pages that carry the label, and those that only name it in their text."""
    has = F.array_contains("labels", label)
    return pages.where(has | F.contains(F.lower("plain_text"), F.lit(label.lower()))).select("id", F.coalesce(has, F.lit(False)).alias("has_label"))


def field_profile(values: DataFrame) -> DataFrame:
    """Shape of each field of ``field, value``: zero share, distinct values, order statistics, class of shape; a null value counts as a row alone.

    Equal values are one row with a count from the first step on.  Order statistics are exact: ranges of values know how many come
    before them, so a rank is looked for in the one range that holds it, and no field is sorted in one task.
    """
    counts = materialise(values.groupBy("field", "value").agg(F.count("*").alias("c")), "values")
    v, c = F.col("value"), F.col("c")
    some = v.isNotNull()
    s = counts.groupBy("field").agg(
        (F.sum(F.when(v == 0, c).otherwise(0)) / F.sum("c")).alias("zero_share"), F.count("value").alias("n_distinct"), F.min("value").alias("min"), F.max("value").alias("max"), F.coalesce(F.sum(F.when(some, c)), F.lit(0)).alias("n"),
        (F.sum(v * c) / F.sum(F.when(some, c))).alias("mean"), F.bool_and(v.isin(0.0, 1.0)).alias("binary"),
    )
    spread = counts.join(F.broadcast(s.select("field", "mean")), "field").groupBy("field").agg(F.sqrt(F.sum((v - F.col("mean")) * (v - F.col("mean")) * c) / F.sum(F.when(some, c))).alias("std"))
    ranged = materialise(counts.where(some).repartitionByRange(shuffle_partitions(values.sparkSession), "field", "value").withColumn("range", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("field", "range").agg(F.sum("c").alias("held")).withColumn("before", F.sum("held").over(W.partitionBy("field").orderBy("range")) - F.col("held"))
    # a percentile lies between the values at two ranks, counted from 0
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("p"), ((F.col("n") - 1) * q).alias("at")) for k, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))))).alias("x")
    ranks = s.where("n > 0").select("field", at).select("field", "x.p", "x.at").select("field", "p", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    placed = ranks.join(before, "field").where("rank >= before and rank < before + held").select("field", "range", "p", "at", "rank", "before")
    upto = F.sum("c").over(W.partitionBy("field", "range").orderBy("value"))
    run = ranged.join(F.broadcast(placed.select("field", "range", "before").distinct()), ["field", "range"]).withColumn("upto", F.col("before") + upto).drop("before")
    hit = run.join(F.broadcast(placed.select("field", "range", "p", "at", "rank")), ["field", "range"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - c))
    weight = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("rank") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    percentile = hit.groupBy("field").agg(*(F.sum(F.when(F.col("p") == k, v * weight)).alias(k) for k in ("p25", "p50", "p75", "p95")))
    s = s.join(spread, "field").join(percentile, "field", "left").select("field", "zero_share", "n_distinct", "min", "p25", "p50", "p75", "p95", "max", "mean", "std", "binary")
    heavy = F.coalesce(F.try_divide("max", "p95"), F.lit(0.0)) > 3
    shape = F.when(F.col("n_distinct") == 1, "constant").when(F.col("binary"), "binary").when(F.col("zero_share") > 0.8, "mostly_zero").when((F.col("n_distinct") <= 8) & (F.col("max") <= 10), "small_int")
    shape = shape.when(heavy, "heavy_tail").when((F.col("min") >= 0) & (F.col("max") <= 1), "ratio_0_1").otherwise("other")
    return s.withColumn("shape", shape).drop("binary")


def threshold_sweep(predictions: DataFrame) -> DataFrame:
    """For thresholds 0.10 to 0.90: how many pages stay labelled."""
    t = F.explode(F.transform(F.sequence(F.lit(2), F.lit(18)), lambda i: F.round(i * 0.05, 2))).alias("threshold")
    counts = predictions.groupBy(F.floor(F.col("confidence") * 1000000).alias("c")).count()
    swept = counts.select(t, "c", "count").groupBy("threshold").agg(F.sum(F.when(F.col("c") >= F.round(F.col("threshold") * 1000000), F.col("count")).otherwise(0)).alias("n_labelled"), F.sum("count").alias("n"))
    return swept.select("threshold", "n_labelled", (F.col("n") - F.col("n_labelled")).alias("n_unlabelled"), F.round(100.0 * F.col("n_labelled") / F.col("n"), 4).alias("pct_labelled"))


def check_ids(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, problem`` of requested ids that don't exist or come twice."""
    lost = wanted.select("id").distinct().join(pages.select("id"), "id", "left_anti").withColumn("problem", F.lit("missing"))
    twice = wanted.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    return lost.unionByName(twice)


def resolve_space(spaces: DataFrame, text: str) -> DataFrame:
    """The space whose id, short id or alias (in that order) equals ``text`` in any case, else INVALID."""
    same = lambda c: F.lower(c) == text.lower()
    rank = F.when(same("id"), 1).when(same("short_id"), 2).when(same("alias"), 3)
    return spaces.select(F.col("id"), rank.alias("rank")).where("rank is not null").agg(F.coalesce(F.min_by("id", "rank"), F.lit("INVALID")).alias("space_id"))


def filter_spaces(spaces: DataFrame, keywords: list[str]) -> DataFrame:
    hit = F.lit(not keywords)
    for k in keywords:
        for c in ("id", "short_id", "alias"):
            hit = hit | F.startswith(F.lower(c), F.lit(k.lower()))
    return spaces.where(hit)
