"""The generic tables as a documentation corpus: pages with spaces, types, labels, links and a tree.

Expressions in both dialects are stated once; where the dialects differ there are two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of the corpus: one SQL expression, or one for Spark and one for DuckDB.
CORPUS = {
    "id": "CAST(page_id AS STRING)",
    "n": "page_id",
    "title": "regexp_extract(html, '<title>(.*?)</title>', 1)",
    "space_id": "regexp_extract(url, 'https?://[^/]+/([^/]+)/', 1)",
    "html": "html",
    "version": "CAST(1 + page_id % 5 AS INT)",
    "last_modified": "CASE WHEN page_id % 2 = 0 THEN '2024-01-15T10:00:00Z' WHEN page_id % 3 = 0 THEN '2023-06-30T00:00:00Z' ELSE '2022-12-01T08:30:00Z' END",
    "page_type": "CASE page_id % 7 WHEN 1 THEN 'meeting_minutes' WHEN 2 THEN 'release_notes' WHEN 3 THEN 'landing_page' WHEN 4 THEN 'canonical_intro' WHEN 5 THEN 'solution_docs' WHEN 6 THEN 'performance_test' END",
    "word_count": (
        "CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN 12 ELSE size(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' '), '[^ \\\\t\\\\n\\\\r]+', 0)) END",
        "CAST(CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN 12 ELSE len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^ \\t\\n\\r]+')) END AS INT)",
    ),
    "link_count": ("CASE WHEN page_id % 9 = 0 THEN 0 ELSE regexp_count(html, '<a href=') END", "CAST(CASE WHEN page_id % 9 = 0 THEN 0 ELSE len(regexp_extract_all(html, '<a href=')) END AS INT)"),
    "has_link_tree": "page_id % 4 = 0",
    "child_list": ("slice(array('a', 'b'), 1, CAST(page_id % 3 AS INT))", "list_slice(['a', 'b'], 1, page_id % 3)"),
    "labels": ("CASE WHEN page_id % 5 = 0 THEN array() ELSE array(concat('mod', page_id % 4), concat('lang-', regexp_extract(url, 'https?://[^/]+/([^/]+)/', 1))) END", "CASE WHEN page_id % 5 = 0 THEN [] ELSE ['mod' || (page_id % 4), 'lang-' || regexp_extract(url, 'https?://[^/]+/([^/]+)/', 1)] END"),
    "eval_notes": ("CASE page_id % 3 WHEN 0 THEN array('lead-para-good') WHEN 1 THEN array('page-too-long', 'lead-para-good') ELSE array() END", "CASE page_id % 3 WHEN 0 THEN ['lead-para-good'] WHEN 1 THEN ['page-too-long', 'lead-para-good'] ELSE [] END"),
    "excerpts": (
        "transform(CASE page_id % 4 WHEN 0 THEN array('excerpt') WHEN 1 THEN array('navbox', 'excerpt') ELSE array() END, t -> named_struct('type', t, 'name', 'a', 'is_source', true, 'source_id', CAST(page_id AS STRING)))",
        "CASE page_id % 4 WHEN 0 THEN ['excerpt'] WHEN 1 THEN ['navbox', 'excerpt'] ELSE [] END",
    ),
    "duplicate_list": ("CASE WHEN page_id % 6 = 0 THEN array('x', 'y') ELSE array() END", "CASE WHEN page_id % 6 = 0 THEN ['x', 'y'] ELSE [] END"),
}
LINKS = {
    "src": "CAST(l_orderkey % 1000 AS STRING)",
    "space_id": "'S' || CAST(l_orderkey % 4 AS STRING)",
    "key": "'S' || CAST(l_partkey % 4 AS STRING)",
    "target": "CAST(l_partkey * 3 AS STRING)",
}


def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Only the columns asked for are read and computed."""
    pick = {c: CORPUS[c] for c in columns or CORPUS}
    return table(spark, sf_dir, "pages").selectExpr(*(f"{e if isinstance(e, str) else e[0]} AS {c}" for c, e in pick.items()))


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores dealt out to all of them; larger tables are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in LINKS.items()))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id > 0").selectExpr("CAST((page_id - 1) DIV 3 AS STRING) AS parent", "CAST(page_id AS STRING) AS child")


def spaces(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("short_id"), F.concat(F.lit("Space "), F.col("id").cast("string")).alias("alias"), F.col("id").cast("string").alias("id")).where("id <> '3'")


CORPUS_SQL = "corpus AS (SELECT " + ", ".join(f"{e if isinstance(e, str) else e[1]} AS {c}" for c, e in CORPUS.items()) + " FROM pages)"
LINKS_SQL = "links AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in LINKS.items()) + " FROM lineitem)"
TREE_SQL = "tree AS (SELECT CAST((page_id - 1) // 3 AS STRING) AS parent, CAST(page_id AS STRING) AS child FROM pages WHERE page_id > 0)"
SPACES_SQL = "spaces AS (SELECT 'S' || i AS short_id, 'Space ' || i AS alias FROM range(3) t(i))"
