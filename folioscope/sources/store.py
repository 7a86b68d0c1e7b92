"""A corpus in a folder: its tables, spaces, snapshots, vectors and models.

``<root>/pages``, ``labels``, ``authors`` and ``vectors`` are Parquet tables, each in a new folder for each version with a
pointer to the present one, so a reader never sees half a table; ``spaces.json`` and ``connection.json`` are
small files of the driver's; ``snapshots/date=.../stage=...`` are tables of their own.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.stats import filter_spaces, resolve_space
from . import tables

SCHEMAS = {"pages": S.PAGES, "labels": S.LABELS, "authors": S.AUTHORS, "vectors": S.VECTORS}
STAGES = ("dehydrated", "hydrated")


class Corpus:
    """The root is a folder that the driver can list, on storage that it shares with the executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    # tables

    def table(self, name: str) -> DataFrame:
        """A stored table; empty if there is none yet.  Columns that an older one lacks are null."""
        if name not in SCHEMAS:
            raise ValueError(f"no such table: {name}")
        pointer = self._path(name, "_present")
        if not os.path.exists(pointer):
            return self.spark.createDataFrame([], SCHEMAS[name])
        with open(pointer, encoding="utf-8") as f:
            return self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name, f.read().strip()))

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Replace a table by ``rows``, which may read the present one; returns the new one."""
        version = f"v-{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        empty.unionByName(rows.select(*(c for c in rows.columns if c in empty.columns)), allowMissingColumns=True).write.parquet(self._path(name, version))
        pointer = self._path(name, "_present")
        with open(pointer + ".new", "w", encoding="utf-8") as f:
            f.write(version)
        os.replace(pointer + ".new", pointer)
        for old in os.listdir(self._path(name)):
            if old.startswith("v-") and old != version:
                shutil.rmtree(self._path(name, old))
        return self.table(name)

    def views(self) -> None:
        """All tables as temporary views under their own names, for SQL."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)
        self.spaces().createOrReplaceTempView("spaces")

    # spaces

    def _space_file(self) -> dict:
        path = self._path("spaces.json")
        if not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def spaces(self) -> DataFrame:
        """``id, short_id, alias`` of the configured spaces."""
        return self.spark.createDataFrame([(v["id"], v["short_id"], v.get("alias")) for _, v in sorted(self._space_file().items())], S.SPACES)

    def add_space(self, space_id: str, short_id: str, alias: str) -> None:
        self._save_spaces(self._space_file() | {f"space_{short_id}": {"id": space_id, "short_id": short_id, "alias": alias}})

    def remove_space(self, short_id: str) -> None:
        """From the configuration; its pages go with the next full sync."""
        known = self._space_file()
        if f"space_{short_id}" not in known:
            raise ValueError(f"no such space: {short_id}")
        self._save_spaces({k: v for k, v in known.items() if k != f"space_{short_id}"})

    def _save_spaces(self, spaces: dict) -> None:
        os.makedirs(self.root, exist_ok=True)
        with open(self._path("spaces.json.new"), "w", encoding="utf-8") as f:
            json.dump(spaces, f, indent=2, sort_keys=True)
        os.replace(self._path("spaces.json.new"), self._path("spaces.json"))

    def find_spaces(self, keywords: list[str]) -> DataFrame:
        return filter_spaces(self.spaces(), keywords).orderBy("short_id")

    def space_id(self, text: str | None) -> str | None:
        """The id of a space by id, key or alias in any case; an unknown one is an error."""
        if text is None:
            return None
        found = resolve_space(self.spaces(), text).head()[0]
        if found == "INVALID":
            raise ValueError(f"no such space: {text}")
        return found

    # snapshots

    def snapshots(self) -> DataFrame:
        """``date, stage``, the newest first."""
        found = []
        if os.path.isdir(self._path("snapshots")):
            for d in os.listdir(self._path("snapshots")):
                if d.startswith("date="):
                    found += [(d[5:], s[6:]) for s in os.listdir(self._path("snapshots", d)) if s.startswith("stage=")]
        return self.spark.createDataFrame(found, "date string, stage string").orderBy(F.desc("date"), "stage")

    def dehydrated_only(self) -> DataFrame:
        """Dates with a dehydrated snapshot and no hydrated one, the newest first."""
        every = self.snapshots()
        return every.where("stage = 'dehydrated'").select("date").exceptAll(every.where("stage = 'hydrated'").select("date")).orderBy(F.desc("date"))

    def take_snapshot(self, stage: str = "dehydrated") -> str:
        """Of the present pages, under the date they were fetched; one of the same day is replaced."""
        if stage not in STAGES:
            raise ValueError(f"stage: {stage}")
        pages = self.table("pages")
        date = tables.snapshot_date(pages).head()[0]
        if date is None:
            raise ValueError("no page has a date of retrieval")
        tables.write_snapshot(pages, self._path("snapshots"), str(date), stage)
        return str(date)

    def resolve_snapshot(self, ref: str) -> str:
        """A date in either form, ``latest``, or a snapshot's name."""
        known = sorted({r.date for r in self.snapshots().collect()})
        if ref == "latest" and known:
            return known[-1]
        date = tables.parse_snapshot_date(snapshot_parts(ref)[0] if "." in ref else ref)
        if date not in known:
            raise ValueError(f"no snapshot of {date}")
        return date

    def snapshot(self, ref: str) -> DataFrame:
        """The hydrated pages of a snapshot; one that is only dehydrated is hydrated first."""
        from ..operators.enrich import enrich

        date = self.resolve_snapshot(ref)
        root = self._path("snapshots")
        if not os.path.isdir(os.path.join(root, f"date={date}", "stage=hydrated")):
            base = tables.read_snapshot(self.spark, root, date, "dehydrated")
            tables.write_snapshot(enrich(base, self.spaces()), root, date, "hydrated")
        return tables.read_snapshot(self.spark, root, date, "hydrated")

    # models

    def save_model(self, model: PipelineModel, signal_keys: tuple[str, ...], threshold: float = S.CONFIDENCE) -> None:
        model.write().overwrite().save(self._path("models", "types"))
        about = {"classes": list(model.stages[0].labels), "signal_keys": list(signal_keys), "confidence_threshold": threshold}
        with open(self._path("models", "types.json"), "w", encoding="utf-8") as f:
            json.dump(about, f, indent=2)

    def load_model(self, signal_keys: tuple[str, ...]) -> tuple[PipelineModel, dict]:
        """The model and what is known of it; a model of other signals is an error."""
        with open(self._path("models", "types.json"), encoding="utf-8") as f:
            about = json.load(f)
        if about["signal_keys"] != list(signal_keys):
            raise ValueError("the model was fitted on other signals")
        return PipelineModel.load(self._path("models", "types")), about


def snapshot_name(date: str, stage: str) -> str:
    return f"corpus_{date.replace('-', '_')}.{stage}"


def snapshot_parts(name: str) -> tuple[str, str]:
    """Date and stage of a snapshot's name."""
    head, dot, stage = name.rpartition(".")
    if not dot or stage not in STAGES or not head.startswith("corpus_"):
        raise ValueError(f"not a snapshot: {name}")
    return tables.parse_snapshot_date(head.removeprefix("corpus_")), stage


def store_vectors(present: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` stand for those of the same id."""
    return present.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def loaded_vectors(vectors: DataFrame, column: str = "scaled") -> DataFrame:
    """``id, vec`` of the pages that have a vector."""
    return vectors.where(F.col(column).isNotNull()).select("id", F.col(column).alias("vec"))
