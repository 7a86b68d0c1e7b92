"""The REST source from JSON files, the corpus store, sync and the command line."""

import json
import urllib.error

import pytest

from folioscope.sources import rest, store, tables
from folioscope.sources.config import EngineConfig


def _put(folder, endpoint, results, cursor=None, after=None):
    page = {"results": results, "_links": {"next": f"/x?cursor={after}"} if after else {}}
    (folder / rest.replay_file(endpoint, cursor)).write_text(json.dumps(page))


PAGES = {
    "1": ("Home", 3, "<h1>Home</h1><p>Welcome to the home page of our wiki, where many words stand so that it is no stub at all and can be read by all of us every day.</p>"
          '<p>See <ac:link><ri:page ri:content-title="Guide"/></ac:link> for more.</p>'),
    "2": ("Guide", 1, "<p>The guide says what to do and when, with as many words as are needed to fill a page that is longer than twenty five words in all of its text.</p>"),
    "3": ("Guide copy", 2, "<p>The guide says what to do and when, with as many words as are needed to fill a page that is longer than twenty five words in all of its text.</p>"),
    "4": ("Empty", 1, ""),
}


@pytest.fixture
def server(tmp_path):
    folder = tmp_path / "server"
    folder.mkdir()
    listed = [{"id": i, "version": {"number": v}, "spaceId": "100", "_links": {"tinyui": f"/x/{i}"}, "status": "current"} for i, (_, v, _) in PAGES.items()]
    _put(folder, "spaces/100/pages", listed[:2], None, "c2")
    _put(folder, "spaces/100/pages", [*listed[2:], {"id": "9", "version": {"number": 1}, "spaceId": "100", "status": "archived"}], "c2")
    bodies = [{"id": i, "title": t, "version": {"number": v, "createdAt": "2024-01-02T03:04:05Z"}, "body": {"storage": {"value": h}}} for i, (t, v, h) in PAGES.items()]
    for endpoint in rest.batches(list(PAGES)):
        _put(folder, endpoint, bodies)
    _put(folder, "pages/1/children", [{"id": "2"}, {"id": "3"}])
    for i in ("2", "3", "4"):
        _put(folder, f"pages/{i}/children", [])
        _put(folder, f"pages/{i}/versions", [{"authorId": "b", "number": 1}])
    _put(folder, "pages/1/versions", [{"authorId": "a", "number": 3}, {"authorId": "a", "number": 2}, {"authorId": "b", "number": 1}])
    for order in ("a%2Cb", "b%2Ca"):
        _put(folder, f"users-bulk?accountId={order}", [{"accountId": "a", "publicName": "Ann", "displayName": "Müller, Ann", "email": "a@x"}])
    _put(folder, "spaces/100/content/labels", [{"id": "L1", "name": "howto"}, {"id": "L2", "name": "gone"}])
    _put(folder, "labels/L1/pages", [{"id": "2", "status": "current"}, {"id": "1", "status": "current"}, {"id": "9", "status": "trashed"}])
    return folder


def test_rest_reads_all_pages(spark, server):
    listed = rest.listed_pages(spark, str(server), ["100"])
    assert sorted((r.id, r.version, r.space_id, r.tiny_link) for r in listed.collect()) == [(i, v, "100", f"/x/{i}") for i, (_, v, _) in PAGES.items()]
    bodies = rest.page_bodies(spark, str(server), list(PAGES))
    assert {r.id: (r.title, r.version, r.html) for r in bodies.collect()} == PAGES
    assert sorted((r.id, r.child) for r in rest.children(spark, str(server), ["1", "2", "77"]).collect()) == [("1", "2"), ("1", "3")]
    lists = rest.child_lists(rest.children(spark, str(server), ["1", "2"]), spark.createDataFrame([("1",), ("2",)], "id string"))
    assert {r.id: r.child_list for r in lists.collect()} == {"1": ["2", "3"], "2": []}
    assert [r.author_id for r in rest.versions(spark, str(server), ["1"]).orderBy("pos").collect()] == ["a", "a", "b"]
    assert [(r.author_id, r.name, r.email) for r in rest.users(spark, str(server), ["a", "b"]).collect()] == [("a", "Ann", "a@x")]
    assert sorted((r.id, r.label, r.space_id) for r in rest.labels(spark, str(server), ["100"]).collect()) == [("L1", "howto", "100"), ("L2", "gone", "100")]
    assert sorted(r.id for r in rest.label_pages(spark, str(server), ["L1", "L2"]).collect()) == ["1", "2"]


def test_rest_is_whole_or_fails(server, monkeypatch):
    root = str(server)
    with pytest.raises(rest.Missing):
        list(rest.pages_of(root, "spaces/7/pages"))
    (server / rest.replay_file("spaces/100/pages", "c2")).unlink()
    with pytest.raises(OSError, match="lost"):
        list(rest.pages_of(root, "spaces/100/pages"))
    assert len(list(rest.pages_of(root, "spaces/100/pages", most=2))) == 2
    _put(server, "loop", [{"id": "1"}], None, "again")
    _put(server, "loop", [{"id": "2"}], "again", "again")
    with pytest.raises(OSError, match="does not go on"):
        list(rest.pages_of(root, "loop"))
    calls = []

    def fail(request, timeout):
        calls.append(request.full_url)
        raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)

    monkeypatch.setattr(rest.urllib.request, "urlopen", fail)
    monkeypatch.setattr(rest.time, "sleep", lambda s: None)
    with pytest.raises(OSError, match="HTTP 503"):
        list(rest.pages_of("https://wiki.invalid", "spaces/1/pages", token="secret"))
    assert len(calls) == rest.TRIES and not any("secret" in c for c in calls)


@pytest.fixture
def corpus(spark, tmp_path):
    c = store.Corpus(spark, str(tmp_path / "corpus"))
    c.add_space("100", "DOC", "Documents")
    c.add_space("200", "OPS", "Operations")
    c.remove_space("OPS")
    return c


def test_sync_and_commands(spark, server, corpus, capsys):
    from folioscope import cli
    from folioscope.plans.sync import sync

    ran = [name for name, _ in sync(corpus, str(server))]
    assert ran[:4] == ["pages", "children", "authors", "labels"] and "enrich" in ran and "find_duplicates" in ran
    pages = {r.id: r for r in corpus.table("pages").collect()}
    assert sorted(pages) == list(PAGES) and pages["1"].links_list == ["DOC:2"] and "[[link to: DOC:2]]" in pages["1"].plain_text
    assert pages["1"].child_list == ["2", "3"] and pages["1"].authors == ["ann:mueller", "ann:mueller", "b"] and pages["2"].labels == ["howto"] and pages["3"].labels == []
    assert pages["2"].duplicate_list == pages["3"].duplicate_list == ["2", "3"] and pages["1"].duplicate_list == [] and pages["4"].word_count == 0
    assert all(p.processed_version == p.version for p in pages.values())
    assert [name for name, _ in sync(corpus, str(server))] == ["pages"]
    assert "enrich" in [name for name, _ in sync(corpus, str(server), from_step="excerpts")]
    with pytest.raises(ValueError):
        sync(corpus, str(server), from_step="nothing")

    smoke = cli.run(corpus, cli.build().parse_args(["--corpus", corpus.root, "smoke-test"])).collect()
    assert [(r.command, r.status) for r in smoke if r.status != "ok"] == []
    said = {r.command for r in smoke}
    assert {"overview", "overview --corpus", "sql columns", "stats empty stubs", "stats empty blanks --ids-only", "labels", "excerpts"} <= said
    assert not any(x.split()[0] in ("sync", "move-pages", "smoke-test") for x in said)

    def said(*words):
        assert cli.main(["--corpus", corpus.root, *words, "--json"], spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert [x["id"] for x in said("stats", "children", "1")] == ["2", "3"]
    assert [x["id"] for x in said("stats", "links", "incoming", "2", "--ids-only")] == ["1"]
    assert [x["id"] for x in said("stats", "duplicates")] == ["2", "3"] and said("stats", "empty", "blanks")[0]["id"] == "4"
    assert said("sql", "query", 'select id, title as "t" from pages where title like \'GUIDE\'') == [{"id": "2", "t": "Guide"}]
    assert said("labels")[0] == {"label": "howto", "n_pages": 2}
    assert {x["status"] for x in said("labels", "merge", "howto", "guide")} == {"dry-run"}
    assert said("move-pages", "4", "2") == [{"child": "2", "old_parent": "1", "new_parent": "4", "status": "dry-run"}]
    assert said("preview", "2")[0]["title"] == "Guide" and said("overview")[0]["total_pages"] == 4
    assert {x["setting"]: x["value"] for x in said("connection", "token", "abc")}["token"] == "SECRET"
    assert cli.main(["--corpus", corpus.root, "preview", "77"], spark) == 1
    assert cli.main(["--corpus", corpus.root, "stats", "authors", "--space", "nowhere"], spark) == 1


def test_dead_pages_go_with_a_whole_sync(spark, server, corpus):
    from folioscope.plans.sync import sync

    sync(corpus, str(server))
    old = corpus.table("pages").where("id = '4'")
    extra = old
    for i in range(60):
        extra = extra.unionByName(old.selectExpr(*(f"'{1000 + i}' AS id" if c == "id" else c for c in old.columns)))
    corpus.write("pages", corpus.table("pages").where("id <> '4'").unionByName(extra))
    with pytest.raises(RuntimeError, match="force"):
        sync(corpus, str(server))
    sync(corpus, str(server), force=True)
    assert sorted(r.id for r in corpus.table("pages").collect()) == list(PAGES)


def test_snapshots(spark, corpus):
    base = spark.createDataFrame([("1", "T", 1, "2024-01-01", "100", "<p>a b c</p>", "/x", "2024-03-05T01:02:03Z", ["2"])], "id string, title string, version int, last_modified string, space_id string, html string, tiny_link string, retrieved_at string, child_list array<string>")
    corpus.write("pages", base)
    assert corpus.take_snapshot() == "2024-03-05" and corpus.take_snapshot() == "2024-03-05"
    tables.write_snapshot(base, corpus.root + "/snapshots", "2024-02-01", "dehydrated")
    assert [tuple(r) for r in corpus.snapshots().collect()] == [("2024-03-05", "dehydrated"), ("2024-02-01", "dehydrated")]
    assert corpus.resolve_snapshot("latest") == corpus.resolve_snapshot("2024_03_05") == corpus.resolve_snapshot("corpus_2024_03_05.dehydrated") == "2024-03-05"
    assert [r.word_count for r in corpus.snapshot("latest").collect()] == [3]
    assert [r.date for r in corpus.dehydrated_only().collect()] == ["2024-02-01"]
    with pytest.raises(ValueError):
        corpus.resolve_snapshot("2020-01-01")
    assert store.snapshot_parts(store.snapshot_name("2024-03-05", "hydrated")) == ("2024-03-05", "hydrated")


def test_models_keep_their_signals(spark, corpus):
    from folioscope.operators.types import assign_types, cross_validate, fit_types, training_rows

    rows = spark.createDataFrame([(str(i), [float(i % 2), float(i % 3) / 9]) for i in range(40)], "id string, vec array<double>")
    seeds = rows.selectExpr("id", "CASE WHEN CAST(id AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS type")
    ambiguous = seeds.unionByName(spark.createDataFrame([("0", "odd")], "id string, type string"))
    train = training_rows(ambiguous, rows)
    assert train.count() == 39 and {round(r.weight, 6) for r in train.collect()} == {round(39 / (2 * 19), 6), round(39 / (2 * 20), 6)}
    model = fit_types(train, trees=5)
    corpus.save_model(model, ("a", "b"))
    again, about = corpus.load_model(("a", "b"))
    assert about["classes"] == ["even", "odd"]
    typed = {r.id: r.page_type for r in assign_types(rows, again).collect()}
    assert typed == {str(i): "odd" if i % 2 else "even" for i in range(40)}
    assert {r.page_type for r in assign_types(rows, again, 1.1).collect()} == {"uncategorized"}
    assert sum(r.n for r in cross_validate(train, 3, 5).where("type = page_type").collect()) == 39
    with pytest.raises(ValueError):
        corpus.load_model(("a", "c"))


def test_small_tables(spark, tmp_path):
    seeds = tmp_path / "seeds.csv"
    seeds.write_text("intro,1,2,\nminutes,3,x,\n\nintro,2,4\n")
    assert sorted(tuple(r) for r in tables.seed_labels(spark, str(seeds)).collect()) == [("intro", "1"), ("intro", "2"), ("intro", "4"), ("minutes", "3")]
    assert tables.parse_ids("1, 2 3,4") == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        tables.parse_ids("1,b")
    pages = spark.createDataFrame([(str(i),) for i in range(20)], "id string")
    assert tables.random_pages(pages, 5).count() == 5 == tables.random_pages(pages.limit(2), 5, replacement=True).count()
    assert tables.random_pages(pages, 7).collect() == tables.random_pages(pages, 7).collect()
    tables.create_table(spark, "fs_t", "id string, n int", hard=True)
    tables.create_table(spark, "fs_t", "id string")
    assert tables.column_names(spark, "fs_t") == ["id", "n"]
    tables.drop_table(spark, "fs_t")
    config = EngineConfig("a@x", "https://w", "hidden")
    config.save(str(tmp_path / "c.json"))
    assert EngineConfig.load(str(tmp_path / "c.json")) == config and "hidden" not in repr(config) and (tmp_path / "c.json").stat().st_mode & 0o777 == 0o600
    with pytest.raises(ValueError):
        EngineConfig(url="ftp://x")
    with pytest.raises(ValueError):
        tables.lookup(pages, "1", "no_such")


class _Wiki:
    """A server with two versions of its interface, in a thread: it keeps what it is sent, and page 13 always fails."""

    def __init__(self):
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        self.pages = {str(i): {"id": str(i), "version": {"number": 3}, "body": {"storage": {"value": f"<p>{i}</p>"}}} for i in (1, 2, 3, 13)}
        self.labels, self.moves, self.seen, self.lost = {"1": {"old"}, "2": set()}, {}, [], {"2": 1}
        wiki = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, code, body=None):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode() if body is not None else b"")

            def log_message(self, *_):
                pass

            def handle_any(self):
                path, _, query = self.path.partition("?")
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "null")
                wiki.seen.append((self.command, path, self.headers.get("Authorization")))
                parts = path.split("/")
                if "13" in parts:
                    return self.reply(500)
                if parts[2] == "api":
                    page = wiki.pages.get(parts[-1])
                    if page is None:
                        return self.reply(404)
                    if self.command == "GET":
                        return self.reply(200, page)
                    if body["version"]["number"] != page["version"]["number"] + 1:
                        return self.reply(409)
                    page["version"], page["body"] = body["version"], {"storage": {"value": body["body"]["value"]}}
                    if wiki.lost.get(page["id"]):  # it is done, and the answer is lost
                        wiki.lost[page["id"]] -= 1
                        return self.reply(503)
                    return self.reply(200, page)
                if "move" in parts:
                    wiki.moves[parts[5]] = parts[-1]
                    return self.reply(200)
                held = wiki.labels.get(parts[5])
                if held is None:
                    return self.reply(404)
                if self.command == "POST":
                    held.add(body[0]["name"])
                    return self.reply(200, {})
                name = query.partition("=")[2]
                self.reply(204 if name in held else 404)
                held.discard(name)

            do_GET = do_POST = do_PUT = do_DELETE = handle_any

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.root = f"http://127.0.0.1:{self.server.server_port}/wiki/api/v2"


@pytest.fixture
def wiki():
    found = _Wiki()
    yield found
    found.server.shutdown()


def test_changes_are_sent_once(spark, wiki, tmp_path, monkeypatch):
    from folioscope.operators import changes

    path = str(tmp_path / "connection.json")
    EngineConfig(email="a@x", url=wiki.root, token="secret").save(path)
    monkeypatch.setattr(rest, "TRIES", 2)
    sink = rest.Sink(wiki.root, path)
    rows = [("1", "add", "new"), ("1", "remove", "old"), ("2", "remove", "old"), ("9", "add", "new"), ("13", "add", "new"), ("3", "move", "1")]
    sent = changes.send(spark.createDataFrame(rows, "id string, op string, payload string"), sink)
    want = dict(zip([r[:2] for r in rows], ["ok", "ok", "absent", "absent", "failed", "ok"], strict=True))
    for _ in range(2):  # reading the result again sends nothing
        assert {(r.id, r.op): r.status for r in sent.collect()} == want
    assert wiki.labels == {"1": {"new"}, "2": set()} and wiki.moves == {"3": "1"}
    assert sum(method == "POST" and path.endswith("/1/label") for method, path, _ in wiki.seen) == 1
    assert {x for _, _, x in wiki.seen} == {"Basic YUB4OnNlY3JldA=="}

    pages = spark.createDataFrame([(i, f"T{i}", v, "<p>x</p>") for i, v in (("1", 3), ("2", 3), ("3", 2), ("13", 3))], "id string, title string, version int, html string")
    plan = changes.page_writes(pages.select("id", pages["html"], "version").selectExpr("id", "html", "version + 1 as version", "'changed' as status"), pages)
    assert {r.id: r.status for r in changes.send(plan, sink).collect()} == {"1": "ok", "2": "ok", "3": "conflict", "13": "failed"}  # the answer for page 2 was lost once
    assert {r.id: r.status for r in changes.send(plan, sink).collect()} == {"1": "ok", "2": "ok", "3": "conflict", "13": "failed"}  # a task that runs again
    assert wiki.pages["1"]["version"]["number"] == wiki.pages["2"]["version"]["number"] == 4 and wiki.pages["3"]["body"]["storage"]["value"] == "<p>3</p>"


def test_pages_with_a_navigation_box_take_no_include(spark):
    from folioscope.operators.changes import add_excerpts
    from folioscope.schema import EXCERPT

    shown = lambda kind, own: [(kind, "n", own, "7")]
    rows = [("1", "<p>a</p>", 1, "S", shown("navbox", False)), ("2", "<p>a</p>", 1, "S", shown("navbox", True)), ("3", "<p>a</p>", 1, "S", None)]
    pages = spark.createDataFrame(rows, f"id string, html string, version int, space_id string, excerpts array<{EXCERPT}>")
    assert {r.id: r.status for r in add_excerpts(pages, pages.select("id"), "T", "n", "S").collect()} == {"1": "has-navbox", "2": "changed", "3": "changed"}


def test_reads_carry_the_stored_connection(spark, wiki, tmp_path):
    path = str(tmp_path / "connection.json")
    EngineConfig(email="a@x", url=wiki.root, token="secret").save(path)
    found = rest.read(spark, wiki.root, ["pages/1"], "id", connection=path)
    assert found.collect() == [] and {x for _, _, x in wiki.seen} == {"Basic YUB4OnNlY3JldA=="}
    assert "secret" not in found._jdf.queryExecution().toString()
