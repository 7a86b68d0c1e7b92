"""Stored tables: creation, reading and writing, introspection, snapshots, seed labels, vectors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BASE_COLUMNS, PAGE_COLUMNS


def create_table(spark: SparkSession, name: str, schema, hard: bool = False) -> None:
    """Unless it exists; ``hard`` drops it first."""
    if hard:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name, format="parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def column_names(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name)]


def lookup(pages: DataFrame, page_id: str, *fields: str) -> DataFrame:
    """The fields of a page; only known columns can be asked for."""
    unknown = [f for f in fields if f not in PAGE_COLUMNS and f not in pages.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return pages.where(F.col("id") == page_id).select(*fields)


def update_fields(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Values of ``changes(id, ...)`` where there are any."""
    new = changes.select(*(F.col(c).alias(f"new_{c}") for c in changes.columns))
    out = pages.join(new, pages["id"] == new["new_id"], "left")
    return out.select(*(F.coalesce(f"new_{c}", pages[c]).alias(c) if c in changes.columns and c != "id" else pages[c] for c in pages.columns))


def random_pages(pages: DataFrame, count: int, seed: int = 42, replacement: bool = False) -> DataFrame:
    """A sample of ids, fixed by the seed; with ``replacement`` each of ``count`` draws may give any id."""
    if not replacement:
        return pages.select("id").orderBy(F.xxhash64(F.lit(seed), "id")).limit(count)
    draws = pages.select("id", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw")) if count else pages.select("id", F.lit(0).alias("draw")).limit(0)
    return draws.groupBy("draw").agg(F.min_by("id", F.xxhash64(F.lit(seed), "draw", "id")).alias("id")).select("id")


def arrays_from_json(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns that hold JSON arrays of strings as arrays; null for null and for what is no JSON."""
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in columns})


def arrays_to_json(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.to_json(c) for c in columns})


def write_snapshot(pages: DataFrame, root: str, date: str, stage: str) -> None:
    """Replaces the snapshot of that date and stage; ``dehydrated`` ones have the base columns alone."""
    rows = pages.select(*BASE_COLUMNS) if stage == "dehydrated" else pages
    rows.write.mode("overwrite").parquet(f"{root}/date={date}/stage={stage}")


def read_snapshot(spark: SparkSession, root: str, date: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/date={date}/stage={stage}")


def snapshot_date(pages: DataFrame) -> DataFrame:
    return pages.agg(F.to_date(F.to_timestamp(F.max("retrieved_at"))).alias("date"))


def parse_snapshot_date(text: str) -> str:
    found = re.fullmatch(r"(\d{4})[-_](\d{2})[-_](\d{2})", text)
    if not found:
        raise ValueError(f"not a snapshot date: {text}")
    return "-".join(found.groups())


def seed_labels(spark: SparkSession, path: str) -> DataFrame:
    """``type, id`` from ragged rows ``type,id,id,...``; blanks and what isn't a number are passed over."""
    cells = F.split("value", ",")
    rows = spark.read.text(path).select(F.trim(cells[0]).alias("type"), F.explode(F.slice(cells, 2, F.size(cells))).alias("id"))
    return rows.select("type", F.trim("id").try_cast("long").cast("string").alias("id")).where("type <> '' and id is not null").distinct()


def parse_ids(text: str) -> list[str]:
    """Ids from a list with commas or spaces; anything but digits is an error."""
    ids = [x for x in re.split(r"[,\s]+", text.strip()) if x]
    bad = [x for x in ids if not x.isdigit()]
    if bad:
        raise ValueError(f"not page ids: {bad}")
    return ids


def full_labels(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, labels`` for all pages: the sorted set of the labels found, empty where there are none."""
    per = found.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return pages.select("id").join(per, "id", "left").select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def with_links(rows: DataFrame, pages: DataFrame, base_url: str) -> DataFrame:
    """With a clickable ``link``; the base URL is joined with one slash."""
    tiny = pages.select("id", "tiny_link")
    return rows.join(tiny, "id", "left").withColumn("link", F.concat(F.lit(base_url.rstrip("/") + "/wiki"), "tiny_link", F.lit("/"))).drop("tiny_link")
