"""Deltas, merges and bulk actions, each a pure transformation of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dom import insert_include, strip_includes
from ..storage import materialise


def delta(remote: DataFrame, local: DataFrame, hard: bool = False) -> DataFrame:
    """Ids whose remote version is newer than the local one; all of them if ``hard``."""
    both = remote.select("id", F.col("version").alias("new")).join(local.select("id", F.col("version").alias("old")), "id", "left")
    return both.where(F.lit(hard) | (F.col("new") > F.coalesce("old", F.lit(0)))).select("id")


def dead_pages(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.join(remote.select("id"), "id", "left_anti")


def too_many_dead(dead: int, local: int) -> bool:
    return dead > 50 and dead > 0.1 * local


def replace_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` stand for those of the same id; what they don't have becomes null."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)


def merge_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values of ``new`` where it has any, otherwise those of ``old``."""
    n = new.select(*(F.col(c).alias(f"new_{c}") for c in new.columns))
    joined = old.join(n, old["id"] == n["new_id"], "full_outer")
    pick = lambda c: F.coalesce(f"new_{c}", old[c]) if c in new.columns else old[c]
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def mark_processed(pages: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return pages.join(hit, "id", "left").withColumn("processed_version", F.when(F.col("hit"), F.col("version")).otherwise(F.col("processed_version"))).select(*pages.columns)


def label_actions(pages: DataFrame, ids: DataFrame, op: str, label: str, into: str | None = None) -> DataFrame:
    """``id, op, payload`` that add, remove or merge a label on the pages given; nothing is sent."""
    chosen = pages.join(ids.select("id"), "id", "left_semi")
    has = F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), label)
    if op == "add":
        return chosen.where(~has).select("id", F.lit("add").alias("op"), F.lit(label).alias("payload"))
    if op == "remove":
        return chosen.where(has).select("id", F.lit("remove").alias("op"), F.lit(label).alias("payload"))
    steps = F.array(F.struct(F.lit("add").alias("op"), F.lit(into).alias("payload")), F.struct(F.lit("remove").alias("op"), F.lit(label).alias("payload")))
    return chosen.where(has).select("id", F.inline(steps))


def apply_label_actions(pages: DataFrame, actions: DataFrame) -> DataFrame:
    """``pages`` with sorted label sets after the actions that succeeded."""
    sets = lambda op: F.collect_set(F.when(F.col("op") == op, F.col("payload")))
    per = actions.groupBy("id").agg(sets("add").alias("a"), sets("remove").alias("r"))
    empty = F.array().cast("array<string>")
    new = F.sort_array(F.array_except(F.array_union(F.coalesce("labels", empty), F.coalesce("a", empty)), F.coalesce("r", empty)))
    return pages.join(per, "id", "left").withColumn("labels", new).select(*pages.columns)


def add_excerpts(pages: DataFrame, ids: DataFrame, title: str, name: str, source_space: str) -> DataFrame:
    """``id, html, version, status``: with an include; pages that have one or no place for it are left, as are those that
    show a navigation box of another page, where ``pages`` has excerpts."""
    chosen = pages.join(ids.select("id"), "id", "left_semi")
    new = insert_include(F.col("html"), F.col("id"), F.lit(title), F.lit(name), F.col("space_id"), F.lit(source_space))
    boxed = F.exists("excerpts", lambda x: (x["type"] == "navbox") & ~x["is_source"]) if "excerpts" in pages.columns else F.lit(False)
    status = F.when(F.coalesce(boxed, F.lit(False)), "has-navbox").when(F.col("html").contains('ac:name="excerpt-include"'), "has-include").when(new.isNull(), "no-place").otherwise("changed")
    out = chosen.withColumns({"status": status, "new": new})
    return out.select("id", F.when(F.col("status") == "changed", F.col("new")).otherwise(F.col("html")).alias("html"), (F.col("version") + (F.col("status") == "changed").cast("int")).alias("version"), "status")


def remove_excerpts(pages: DataFrame, ids: DataFrame) -> DataFrame:
    chosen = pages.join(ids.select("id"), "id", "left_semi").withColumn("new", strip_includes(F.col("html")))
    changed = F.col("new") != F.col("html")
    return chosen.select("id", F.col("new").alias("html"), (F.col("version") + changed.cast("int")).alias("version"), F.when(changed, "changed").otherwise("unchanged").alias("status"))


def move_pages(tree: DataFrame, ids: DataFrame, parent: str) -> DataFrame:
    """``child, old_parent, new_parent``: the plan of a move; roots have no old parent."""
    return ids.select(F.col("id").alias("child")).distinct().join(tree, "child", "left").select("child", F.col("parent").alias("old_parent"), F.lit(parent).alias("new_parent"))


def apply_moves(tree: DataFrame, plan: DataFrame) -> DataFrame:
    kept = tree.join(plan.select("child"), "child", "left_anti").select("parent", "child")
    return kept.unionByName(plan.select(F.col("new_parent").alias("parent"), "child"))


def send(actions: DataFrame, sink=None) -> DataFrame:
    """Actions with their status; without a sink it is a dry run.

    ``sink`` takes a row and returns a status, or whether it worked.  What it returned is written to the shared folder, so
    that reading the result does not send anything again.
    """
    if sink is None:
        return actions.withColumn("status", F.lit("dry-run"))
    said = lambda x: x if isinstance(x, str) else "ok" if x else "failed"

    def run(batches):
        for pdf in batches:
            yield pdf.assign(status=[said(sink(r)) for r in pdf.to_dict("records")])

    return materialise(actions.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in [*actions.dtypes, ("status", "string")])), "sent")


def page_writes(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, op, payload, title, version`` that write the changed pages of a plan over the versions it was made from."""
    return changed.where("status = 'changed'").select("id", F.lit("put").alias("op"), F.col("html").alias("payload")).join(pages.select("id", "title", "version"), "id")
