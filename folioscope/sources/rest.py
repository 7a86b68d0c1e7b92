"""A paginated REST source, readable by ``spark.read.format("wiki_rest")``; JSON files can stand for the server.

Options: ``root`` (an URL, or a folder with a file per endpoint page), ``endpoints`` (comma-separated),
``fields`` (of each result, as dotted paths), ``limit``, ``most`` (results of an endpoint, for samples; all
if absent), ``missing`` (``error``, or ``skip`` for endpoints that may be gone) and ``partitions`` (endpoints are
dealt to that many; one each if absent).  ``connection`` names a file of settings on the driver, whose e-mail and token
go to the tasks with the reader; without it the token comes from the environment of the executors, named by ``token_env``.
Neither is ever in options, plans or messages.

``Sink`` sends changes.  What it does may be done twice without harm, since a task may run again: a page is written only
over the version that the change was made from, and one that already has the new text counts as written.

A read is complete or fails: only a missing endpoint under ``skip`` is passed over, any other failed request
is tried again and then raises, so Spark runs the task anew or ends the job.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from urllib.parse import parse_qs, quote, urlencode, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .config import EngineConfig

PAUSE_SECONDS, TIMEOUT_SECONDS, TRIES = 0.03, 30, 4
#: Ids in one request for page bodies.
BODIES_AT_ONCE = 25


class Missing(Exception):
    """The server (or folder) has no such endpoint."""


class Refused(OSError):
    """The server will not do it, however often it is asked."""

    def __init__(self, code: int):
        super().__init__(f"HTTP {code}")
        self.code = code


class _Endpoints(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def replay_file(endpoint: str, cursor: str | None = None) -> str:
    """Name of the file that stands for a page of an endpoint."""
    return quote(endpoint, safe="").replace("%2F", "_") + (f".{quote(cursor, safe='')}" if cursor else "") + ".json"


def credentials(connection: str | None) -> str | None:
    """The authorization header for the settings in a file: an e-mail and a token, or a token alone."""
    if not connection or not os.path.exists(connection):
        return None
    config = EngineConfig.load(connection)
    if not config.token:
        return None
    return "Basic " + base64.b64encode(f"{config.email}:{config.token}".encode()).decode() if config.email else f"Bearer {config.token}"


def _request(url: str, token: str | None, method: str = "GET", body: object = None) -> dict:
    headers = {"Authorization": token if token.startswith(("Basic ", "Bearer ")) else f"Bearer {token}"} if token else {}
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, headers | ({"Content-Type": "application/json"} if data else {}), method=method)
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as r:
                text = r.read()
                return json.loads(text) if text.strip() else {}
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                raise Missing(url) from None
            if e.code in (400, 401, 403, 409):
                raise Refused(e.code) from None
            if attempt + 1 == TRIES or (e.code < 500 and e.code != 429):
                raise OSError(f"HTTP {e.code} from {url}") from None
        except OSError as e:
            if attempt + 1 == TRIES:
                raise OSError(f"no answer from {url}: {type(e).__name__}") from None
        time.sleep(2**attempt)
    raise AssertionError


def _get(root: str, endpoint: str, cursor: str | None, limit: int, token: str | None) -> dict:
    if not root.startswith(("http://", "https://")):
        path = os.path.join(root, replay_file(endpoint, cursor))
        if not os.path.exists(path):
            raise Missing(path)
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    more = {"limit": limit} | ({"cursor": cursor} if cursor else {})
    return _request(f"{root.rstrip('/')}/{endpoint}{'&' if '?' in endpoint else '?'}{urlencode(more)}", token)


def pages_of(root: str, endpoint: str, limit: int = 50, most: int | None = None, token: str | None = None) -> Iterator[dict]:
    """Results of all pages of an endpoint.  ``Missing`` if it does not exist; a lost later page is an error."""
    cursor, n, seen = None, 0, set()
    while True:
        try:
            page = _get(root, endpoint, cursor, limit, token)
        except Missing as e:
            if cursor is None:
                raise
            raise OSError(f"a page of {endpoint} is lost: {e}") from None
        for item in page.get("results", []):
            yield item
            n += 1
            if most is not None and n >= most:
                return
        after = (page.get("_links") or {}).get("next")
        if not after:
            return
        cursor = parse_qs(urlparse(after).query).get("cursor", [None])[0]
        if not cursor or cursor in seen:
            raise OSError(f"{endpoint} does not go on after {n} results")
        seen.add(cursor)
        if root.startswith("http"):
            time.sleep(PAUSE_SECONDS)


def _field(item: dict, path: str):
    for part in path.split("."):
        item = item.get(part) if isinstance(item, dict) else None
    return item if item is None or isinstance(item, str) else json.dumps(item)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        if self.options.get("missing", "error") not in ("error", "skip"):
            raise ValueError(f"missing: {self.options['missing']}")
        self.header = credentials(self.options.get("connection"))  # read on the driver; tasks get the reader itself

    def partitions(self) -> list[_Endpoints]:
        names = [e.strip() for e in self.options["endpoints"].split(",") if e.strip()]
        n = min(len(names), int(self.options.get("partitions", len(names))))
        return [_Endpoints(names[i::n]) for i in range(n)]

    def read(self, partition: _Endpoints):
        fields = [f.strip() for f in self.options["fields"].split(",")]
        token = self.header or os.environ.get(self.options.get("token_env", ""))
        most = self.options.get("most")
        for name in partition.names:
            try:
                for item in pages_of(self.options["root"], name, int(self.options.get("limit", 50)), None if most is None else int(most), token):
                    yield (name, *(_field(item, f) for f in fields))
            except Missing:
                if self.options.get("missing", "error") == "error":
                    raise


class Sink:
    """Sends rows ``id, op, payload`` (and for pages ``title, version``) and returns what became of each: ``ok``, ``absent``,
    ``conflict`` (the page is not at the version that the change was made from), ``refused`` or ``failed``.

    Ops are ``add`` and ``remove`` (a label), ``put`` (markup) and ``move`` (below the page ``payload``).
    """

    def __init__(self, root: str, connection: str | None = None):
        self.root, self.header = root.rstrip("/"), credentials(connection)
        self.old = self.root.replace("/api/v2", "/rest/api")

    def __call__(self, row: dict) -> str:
        try:
            return getattr(self, f"_{row['op']}")(row)
        except Missing:
            return "absent"
        except Refused as e:
            return "conflict" if e.code == 409 else "refused"
        except OSError:
            return "failed"

    def _add(self, row: dict) -> str:
        _request(f"{self.old}/content/{row['id']}/label", self.header, "POST", [{"prefix": "global", "name": row["payload"]}])
        return "ok"

    def _remove(self, row: dict) -> str:
        _request(f"{self.old}/content/{row['id']}/label?{urlencode({'name': row['payload']})}", self.header, "DELETE")
        return "ok"

    def _move(self, row: dict) -> str:
        _request(f"{self.old}/content/{row['id']}/move/append/{row['payload']}", self.header, "PUT")
        return "ok"

    def _put(self, row: dict) -> str:
        url, version = f"{self.root}/pages/{row['id']}", int(row["version"])
        body = {"id": row["id"], "status": "current", "title": row["title"], "body": {"representation": "storage", "value": row["payload"]}, "version": {"number": version + 1}}

        def state() -> str | None:
            """``ok`` if an earlier try has written it, None if it is still to be written."""
            now = _request(f"{url}?body-format=storage", self.header)
            at = int(now["version"]["number"])
            return None if at == version else "ok" if at == version + 1 and _field(now, "body.storage.value") == row["payload"] else "conflict"

        done = state()
        if done is None:
            try:
                _request(url, self.header, "PUT", body)
            except Refused as e:
                if e.code != 409:
                    raise
                return state() or "conflict"
        return done or "ok"


class WikiRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki_rest"

    def schema(self) -> str:
        return "endpoint string, " + ", ".join(f"`{f.strip().replace('.', '_')}` string" for f in self.options["fields"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, root: str, endpoints: Iterable[str], fields: str, **options) -> DataFrame:
    """The results of endpoints as strings, a column per field."""
    spark.dataSource.register(WikiRest)
    reader = spark.read.format("wiki_rest").option("root", root).option("endpoints", ",".join(endpoints)).option("fields", fields)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def _last(column: str, mark: str, upto: str | None = None) -> F.Column:
    found = F.substring_index(column, mark, -1)
    return found if upto is None else F.substring_index(found, upto, 1)


def listed_pages(spark: SparkSession, root: str, space_ids: Iterable[str], **options) -> DataFrame:
    """``id, version, space_id, tiny_link`` of the current pages of spaces."""
    rows = read(spark, root, [f"spaces/{s}/pages" for s in space_ids], "id,version.number,spaceId,_links.tinyui,status", **options)
    return rows.where("status = 'current' or status is null").select("id", F.col("version_number").cast("int").alias("version"), F.col("spaceId").alias("space_id"), F.col("_links_tinyui").alias("tiny_link"))


def batches(ids: Iterable[str], size: int = BODIES_AT_ONCE) -> list[str]:
    """Endpoints that fetch page bodies by lists of sorted ids; the ids are separated by ``%2C``, a comma."""
    ids = sorted(set(ids))
    return [f"pages?body-format=storage&id={'%2C'.join(ids[i : i + size])}" for i in range(0, len(ids), size)]


def page_bodies(spark: SparkSession, root: str, ids: Iterable[str], size: int = BODIES_AT_ONCE, **options) -> DataFrame:
    """``id, title, version, last_modified, html``; ids that are gone give no row."""
    rows = read(spark, root, batches(ids, size), "id,title,version.number,version.createdAt,body.storage.value", **options)
    return rows.select("id", "title", F.col("version_number").cast("int").alias("version"), F.col("version_createdAt").alias("last_modified"), F.col("body_storage_value").alias("html"))


def children(spark: SparkSession, root: str, ids: Iterable[str], **options) -> DataFrame:
    """``id, child``; a page that is gone has no children."""
    rows = read(spark, root, [f"pages/{i}/children" for i in ids], "id", **({"missing": "skip"} | options))
    return rows.select(_last("endpoint", "pages/", "/children").alias("id"), F.col("id").alias("child"))


def child_lists(found: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, child_list`` for all of ``ids``: sorted, empty where there are none."""
    per = found.groupBy("id").agg(F.sort_array(F.collect_set("child")).alias("child_list"))
    return ids.select("id").join(per, "id", "left").select("id", F.coalesce("child_list", F.array().cast("array<string>")).alias("child_list"))


def versions(spark: SparkSession, root: str, ids: Iterable[str], **options) -> DataFrame:
    """``id, pos, author_id``: the authors of a page's versions in the order that the server gives."""
    rows = read(spark, root, [f"pages/{i}/versions" for i in ids], "authorId,number", **({"missing": "skip"} | options))
    return rows.select(_last("endpoint", "pages/", "/versions").alias("id"), (-F.col("number").cast("long")).alias("pos"), F.col("authorId").alias("author_id"))


def users(spark: SparkSession, root: str, ids: Iterable[str], size: int = BODIES_AT_ONCE, **options) -> DataFrame:
    """``author_id, name, display_name, email`` of accounts."""
    ids = sorted(set(ids))
    found = [f"users-bulk?accountId={'%2C'.join(ids[i : i + size])}" for i in range(0, len(ids), size)]
    rows = read(spark, root, found, "accountId,publicName,displayName,email", **options)
    return rows.select(F.col("accountId").alias("author_id"), F.col("publicName").alias("name"), F.col("displayName").alias("display_name"), "email")


def labels(spark: SparkSession, root: str, space_ids: Iterable[str], **options) -> DataFrame:
    """``id, label, space_id`` of the labels in use in spaces."""
    rows = read(spark, root, [f"spaces/{s}/content/labels" for s in space_ids], "id,name", **options)
    return rows.select("id", F.col("name").alias("label"), _last("endpoint", "spaces/", "/content").alias("space_id"))


def label_pages(spark: SparkSession, root: str, label_ids: Iterable[str], **options) -> DataFrame:
    """``id, label_id`` of the current pages with a label; a label that is gone has none."""
    rows = read(spark, root, [f"labels/{i}/pages" for i in label_ids], "id,status", **({"missing": "skip"} | options))
    return rows.where("status = 'current' or status is null").select("id", _last("endpoint", "labels/", "/pages").alias("label_id"))
