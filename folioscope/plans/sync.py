"""Sync: fetch what has changed, then enrich in steps that can be resumed; each step writes the tables it changes."""

from __future__ import annotations

import datetime
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import SIGNAL_KEYS
from ..functions.text import author_name
from ..operators.changes import dead_pages, delta, mark_processed, merge_rows, replace_rows, too_many_dead
from ..operators.duplicates import group_members, scan_duplicates
from ..operators.enrich import enrich
from ..operators.stats import author_history
from ..operators.types import assign_types
from ..sources import rest
from ..sources.store import Corpus, loaded_vectors
from ..sources.tables import full_labels
from ..storage import materialise

#: The steps after the pages themselves, in order.
STEPS = ("children", "authors", "labels", "parse_text", "basic_stats", "convert_links", "excerpts", "assign_type", "find_duplicates")
#: Steps that one enrichment of the base columns answers together; resuming at any of them runs it.
_ENRICHED = STEPS[3:7]


def _signed(corpus: Corpus) -> dict[str, str]:
    """Where the e-mail and the token of the requests are stored."""
    path = os.path.join(corpus.root, "connection.json")
    return {"connection": path} if os.path.exists(path) else {}


def _fetch(corpus: Corpus, root: str, space_ids: list[str], hard: bool, whole: bool, force: bool) -> list[str]:
    """Ids of the pages that are new or newer than ours, with their rows stored; lost pages go if all spaces are listed."""
    local = corpus.table("pages")
    listed = materialise(rest.listed_pages(corpus.spark, root, space_ids, **_signed(corpus)), "listed")
    changed = [r.id for r in delta(listed, local.select("id", "version"), hard).collect()]  # the requests that follow are the driver's to plan
    if changed:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        ids = corpus.spark.createDataFrame([(i,) for i in changed], "id string")
        fresh = replace_rows(local, listed.join(ids, "id", "left_semi").withColumn("retrieved_at", F.lit(now)))
        local = corpus.write("pages", merge_rows(fresh, materialise(rest.page_bodies(corpus.spark, root, changed, **_signed(corpus)), "bodies")))
    if whole:
        lost, kept = dead_pages(local, listed).count(), local.count()
        if lost and too_many_dead(lost, kept) and not force:
            raise RuntimeError(f"{lost} of {kept} pages are gone; run again with force to delete them")
        if lost:
            corpus.write("pages", local.join(listed.select("id"), "id", "left_semi"))
    return changed


def _merge(corpus: Corpus, new: DataFrame) -> None:
    corpus.write("pages", merge_rows(corpus.table("pages"), materialise(new, "step")))


def _authors(corpus: Corpus, root: str, ids: list[str]) -> None:
    edits = materialise(rest.versions(corpus.spark, root, ids, **_signed(corpus)), "versions")
    known = corpus.table("authors")
    unknown = [r.author_id for r in edits.where("author_id is not null").select("author_id").distinct().join(known.select("author_id"), "author_id", "left_anti").collect()]
    if unknown:
        found = rest.users(corpus.spark, root, unknown, **_signed(corpus)).withColumn("name_normalized", author_name(F.coalesce("display_name", "name")))
        known = corpus.write("authors", known.unionByName(found, allowMissingColumns=True))
    _merge(corpus, author_history(edits.where("author_id is not null"), known))


def _labels(corpus: Corpus, root: str, space_ids: list[str]) -> None:
    """All labels anew: a label that is gone leaves its pages, too."""
    found = materialise(rest.labels(corpus.spark, root, space_ids, **_signed(corpus)).dropDuplicates(["id"]), "labels")
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    corpus.write("labels", found.withColumn("retrieved_at", F.lit(now)))
    pages = rest.label_pages(corpus.spark, root, [r.id for r in found.select("id").collect()], **_signed(corpus))
    named = pages.join(found.select(F.col("id").alias("label_id"), "label"), "label_id").select("id", "label")
    table = corpus.table("pages")
    corpus.write("pages", table.drop("labels").join(materialise(full_labels(named, table), "page_labels"), "id"))


def _enrich(corpus: Corpus) -> None:
    """Text, counts, links and excerpts of all pages: titles that pages of the delta bring may resolve links of others."""
    pages = corpus.table("pages")
    rich = materialise(enrich(pages, corpus.spaces()), "enriched")
    new = rich.select("id", "plain_text", "lead_para", "word_count", "link_count", "image_count", "has_link_tree", "eval_notes", "links_list", "excerpts")
    keep = [c for c in pages.columns if c == "id" or c not in new.columns]
    corpus.write("vectors", rich.select("id", "raw", "scaled"))
    corpus.write("pages", pages.select(*keep).join(new, "id", "left"))


def _types(corpus: Corpus) -> None:
    model, about = corpus.load_model(SIGNAL_KEYS)
    vectors = corpus.table("vectors")
    typed = materialise(assign_types(loaded_vectors(vectors), model, about["confidence_threshold"]), "types")
    corpus.write("vectors", vectors.drop("type", "type_confidence").join(typed.select("id", F.col("page_type").alias("type"), F.col("confidence").alias("type_confidence")), "id", "left"))
    _merge(corpus, typed.select("id", "page_type"))


def _duplicates(corpus: Corpus) -> None:
    pages = corpus.table("pages")
    groups = materialise(scan_duplicates(pages, loaded_vectors(corpus.table("vectors"))), "groups")
    lists = group_members(groups).select("group_id", F.transform("members", lambda x: x.cast("string")).alias("duplicate_list"))
    new = groups.join(lists, "group_id").select(F.col("id").cast("string").alias("id"), "duplicate_list")
    empty = F.array().cast("array<string>")
    corpus.write("pages", pages.drop("duplicate_list").join(materialise(new, "lists"), "id", "left").withColumn("duplicate_list", F.coalesce("duplicate_list", empty)))


def sync(corpus: Corpus, root: str, space: str | None = None, hard: bool = False, from_step: str | None = None, force: bool = False) -> list[tuple[str, float]]:
    """The steps that ran, with their seconds.  ``from_step`` fetches no pages and works on all stored ones.

    Without ``space`` all configured spaces are listed, and pages that none of them has are deleted; more than 50
    that are more than a tenth of all are an error unless ``force``.
    """
    if from_step is not None and from_step not in STEPS:
        raise ValueError(f"not a step: {from_step}; steps are {', '.join(STEPS)}")
    spaces = [corpus.space_id(space)] if space else [r.id for r in corpus.spaces().collect()]
    ran: list[tuple[str, float]] = []

    def timed(name: str, f, *arguments) -> object:
        start = time.monotonic()
        out = f(*arguments)
        ran.append((name, time.monotonic() - start))
        return out

    if from_step is None:
        ids = timed("pages", _fetch, corpus, root, spaces, hard, space is None, force)
        if not ids:
            return ran
    else:
        ids = [r.id for r in corpus.table("pages").select("id").collect()]
    steps = STEPS[STEPS.index(from_step) if from_step else 0 :]
    if "children" in steps:
        ours = corpus.spark.createDataFrame([(i,) for i in ids], "id string")
        timed("children", lambda: _merge(corpus, rest.child_lists(rest.children(corpus.spark, root, ids, **_signed(corpus)), ours)))
    if "authors" in steps:
        timed("authors", _authors, corpus, root, ids)
    if "labels" in steps:
        timed("labels", _labels, corpus, root, spaces)
    if set(steps) & set(_ENRICHED):
        timed("enrich", _enrich, corpus)
    if "assign_type" in steps:
        try:
            timed("assign_type", _types, corpus)
        except FileNotFoundError:
            ran.append(("assign_type: no model, skipped", 0.0))
    if "find_duplicates" in steps:
        timed("find_duplicates", _duplicates, corpus)
    corpus.write("pages", mark_processed(corpus.table("pages"), corpus.spark.createDataFrame([(i,) for i in ids], "id string")))
    return ran
