"""The command line: ``python -m folioscope --corpus DIR COMMAND ...`` over a stored corpus.

Every command is a DataFrame that is printed, or with ``--json`` written as JSON lines; with ``--ids-only`` only
ids are.  Commands that change a server print what became of each action; with ``--dry-run``, or without a configured
server and token, they print the plan.
"""

from __future__ import annotations

import argparse
import datetime
import os
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fuzzy
from .functions.present import change_text, snippet
from .functions.text import label_name
from .operators import changes, duplicates, links, overview, stats, tree
from .operators.excerpts import excerpt_list
from .sources.config import EngineConfig
from .sources.rest import Sink
from .sources.store import Corpus
from .sources.tables import lookup, parse_ids, with_links


def _space(corpus: Corpus, args) -> tuple[str | None, DataFrame]:
    space = corpus.space_id(getattr(args, "space", None))
    pages = corpus.table("pages")
    return space, pages if space is None else pages.where(F.col("space_id") == space)


def _ids(args) -> list[str]:
    return parse_ids(" ".join(args.pids))


def _id_rows(corpus: Corpus, args) -> DataFrame:
    rows = corpus.spark.createDataFrame([(i,) for i in _ids(args)], "id string")
    problems = [f"{r.id} ({r.problem})" for r in stats.check_ids(rows, corpus.table("pages")).collect()]
    if problems:
        raise ValueError(f"page ids: {', '.join(problems)}")
    return rows


def _config(corpus: Corpus) -> tuple[str, EngineConfig]:
    path = os.path.join(corpus.root, "connection.json")
    return path, EngineConfig.load(path) if os.path.exists(path) else EngineConfig()


def connection(corpus: Corpus, args) -> DataFrame:
    path, config = _config(corpus)
    if args.field != "status":
        if args.value is None:
            raise ValueError(f"connection {args.field} needs a value")
        config = EngineConfig(**{**config.__dict__, args.field.replace("-", "_"): args.value})
        os.makedirs(corpus.root, exist_ok=True)
        config.save(path)
    shown = {k: ("SECRET" if v else "") if k == "token" else v for k, v in config.__dict__.items()}
    return corpus.spark.createDataFrame([(k, v or "(not set)") for k, v in shown.items()], "setting string, value string")


def spaces(corpus: Corpus, args) -> DataFrame:
    if args.action == "add":
        corpus.add_space(args.rest[0], args.rest[1] if len(args.rest) > 1 else args.rest[0], args.rest[-1])
    elif args.action == "remove":
        corpus.remove_space(args.rest[0])
    return corpus.find_spaces(args.filter or [])


def sync(corpus: Corpus, args) -> DataFrame:
    from .plans.sync import sync as run

    root = args.root or _config(corpus)[1].url
    if not root:
        raise ValueError("no server: set `connection url` or pass --root")
    ran = run(corpus, root, args.space, args.hard_refresh, args.from_step, args.force)
    return corpus.spark.createDataFrame([(n, str(datetime.timedelta(seconds=round(s)))) for n, s in ran], "step string, duration string")


def _overview(corpus: Corpus, pages: DataFrame) -> DataFrame:
    return overview.space_overview(pages, links.edges(corpus.table("pages")))


def show_overview(corpus: Corpus, args) -> DataFrame:
    space, pages = _space(corpus, args)
    rows = _overview(corpus, pages)
    rows = rows.where("space_id = '*'") if args.corpus_only else rows.where("space_id <> '*'")
    return rows.orderBy("space_id")


def authors(corpus: Corpus, args) -> DataFrame:
    return stats.top_authors(_space(corpus, args)[1], args.limit)


def orphans(corpus: Corpus, args) -> DataFrame:
    _, pages = _space(corpus, args)
    return links.orphans(overview.content_pages(pages).select("id", "title", "space_id"), links.edges(corpus.table("pages"))).orderBy("id")


def popular(corpus: Corpus, args) -> DataFrame:
    pages = corpus.table("pages")
    key = None
    if args.space:
        key = corpus.spaces().where(F.col("id") == corpus.space_id(args.space)).head().short_id
    return links.popular_links(links.edges(pages), pages, corpus.spaces(), key, args.limit).orderBy(F.desc("n_links"), "target")


def cross_space(corpus: Corpus, args) -> DataFrame:
    each = links.edges(_space(corpus, args)[1]).join(corpus.spaces().select(F.col("id").alias("space_id"), F.col("short_id").alias("own_key")), "space_id", "left")
    return links.cross_space(each, F.col("own_key")).orderBy("space_id")


def incoming(corpus: Corpus, args) -> DataFrame:
    pages = corpus.table("pages")
    found = links.incoming(links.edges(pages), args.page_id)
    return found.join(pages.select(F.col("id").alias("src"), "title"), "src", "left").select(F.col("src").alias("id"), "title", "space_id").orderBy("id")


def duplicate_pages(corpus: Corpus, args) -> DataFrame:
    if args.fuzziness == 1.0:
        pages = corpus.table("pages").where(F.size("duplicate_list") > 0)
        return pages.select("id", "title", F.col("duplicate_list")[0].alias("group_id")).orderBy("group_id", "id")
    vectors = corpus.table("vectors").where("scaled is not null").select("id", F.col("scaled").alias("vec"))
    return duplicates.scan_duplicates(corpus.table("pages"), vectors, args.fuzziness).orderBy("group_id", "id")


def empty(corpus: Corpus, args) -> DataFrame:
    kind = {"blanks": stats.blank_pages, "wordless": stats.wordless_pages, "stubs": stats.stubs}[args.kind]
    rows = kind(_space(corpus, args)[1]).withColumn("value", stats.structural_value(F.col("child_list"), F.coalesce("has_link_tree", F.lit(False)), F.col("link_count")))
    if args.no_structural_value:
        rows = rows.where("value = '-'")
    if args.min_age:
        rows = stats.stale(rows, F.current_date(), args.min_age)
    out = rows.select("id", "title", "space_id", "word_count", "last_modified", "value")
    return (with_links(out, corpus.table("pages"), _config(corpus)[1].url) if args.clickable else out).orderBy("id")


def children(corpus: Corpus, args) -> DataFrame:
    pages = corpus.table("pages")
    return tree.descendants(pages, tree.tree_edges(pages), args.page_id, args.max_depth).withColumnRenamed("descendant", "id")


def sql_query(corpus: Corpus, args) -> DataFrame:
    from .plans.passthrough import query

    corpus.views()
    rows = query(corpus.spark, args.sql)[0]
    if args.clickable:
        if "id" not in rows.columns:
            raise ValueError("--clickable needs a column id")
        rows = with_links(rows, corpus.table("pages"), _config(corpus)[1].url)
    return rows


def sql_columns(corpus: Corpus, args) -> DataFrame:
    return corpus.spark.createDataFrame(corpus.table(args.table).dtypes, "column string, type string")


def _sink(corpus: Corpus, args):
    """What sends changes to the configured server; None for a dry run, or without a server and a token."""
    path, config = _config(corpus)
    return None if args.dry_run or not (config.url and config.token) else Sink(config.url, path)


def _send_labels(corpus: Corpus, args, actions: DataFrame) -> DataFrame:
    """Send label actions; those that worked are done to the stored pages, too."""
    sink = _sink(corpus, args)
    sent = changes.send(actions, sink)
    if sink is not None:
        corpus.write("pages", changes.apply_label_actions(corpus.table("pages"), sent.where("status in ('ok', 'absent')")))
    return sent


def _send_pages(corpus: Corpus, args, plan: DataFrame) -> DataFrame:
    """Send changed pages; with a server the plan's status becomes what it said."""
    sink = _sink(corpus, args)
    if sink is None:
        return plan
    sent = changes.send(changes.page_writes(plan, corpus.table("pages")), sink)
    done = sent.select("id", F.col("status").alias("sent"))
    return plan.join(done, "id", "left").select("id", "html", "version", F.coalesce("sent", "status").alias("status"))


def label_command(corpus: Corpus, args) -> DataFrame:
    space, pages = _space(corpus, args)
    if args.action == "list":
        return stats.label_counts(pages, args.limit)
    if args.action == "redundant":
        return fuzzy.redundant_labels(stats.label_counts(pages).withColumnRenamed("n_pages", "pages"), 80)
    if args.action == "mentions":
        found = stats.label_mentions(pages, args.rest[0])
        return found.orderBy(F.desc("has_label"), "id")
    if args.action == "similar":
        return fuzzy.nearest_labels(corpus.table("labels"), args.rest[0], top=5)
    if args.action == "merge":
        old, new = args.rest
        return _send_labels(corpus, args, changes.label_actions(corpus.table("pages"), corpus.table("pages").select("id"), "merge", old, new))
    args.pids = args.rest[1:]
    name = corpus.spark.range(1).select(label_name(F.lit(args.rest[0]))).head()[0]
    return _send_labels(corpus, args, changes.label_actions(corpus.table("pages"), _id_rows(corpus, args), args.action, name))


def excerpt_command(corpus: Corpus, args) -> DataFrame:
    if args.action == "list":
        return excerpt_list(_space(corpus, args)[1], args.sources_only, args.navboxes_only)
    args.pids = args.rest[1:] if args.action == "add" else args.rest
    ids, pages = _id_rows(corpus, args), corpus.table("pages")
    if args.action == "remove":
        return _send_pages(corpus, args, changes.remove_excerpts(pages, ids))
    source = lookup(pages, args.rest[0], "title", "space_id", "excerpts").head()
    if source is None or not any(x.is_source for x in source.excerpts or []):
        raise ValueError(f"page {args.rest[0]} is no source of an excerpt")
    keys = {r.id: r.short_id for r in corpus.spaces().collect()}
    named = pages.withColumn("space_id", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in keys.items() for x in kv)), F.col("space_id")), F.col("space_id"))) if keys else pages
    name = next(x.name for x in source.excerpts if x.is_source)
    return _send_pages(corpus, args, changes.add_excerpts(named, ids, source.title, name, keys.get(source.space_id, source.space_id)))


def move(corpus: Corpus, args) -> DataFrame:
    pages = corpus.table("pages")
    if lookup(pages, args.parent, "id").head() is None:
        raise ValueError(f"no such page: {args.parent}")
    plan = changes.move_pages(tree.parent_map(tree.tree_edges(pages)), _id_rows(corpus, args), args.parent)
    sink = _sink(corpus, args)
    if sink is None:
        return changes.send(plan)
    sent = changes.send(plan.select(F.col("child").alias("id"), F.lit("move").alias("op"), F.col("new_parent").alias("payload")), sink)
    return plan.join(sent.select(F.col("id").alias("child"), "status"), "child")


def preview(corpus: Corpus, args) -> DataFrame:
    row = lookup(corpus.table("pages"), args.page_id, "title", "plain_text").head()
    if row is None:
        raise ValueError(f"no such page: {args.page_id}")
    return corpus.spark.createDataFrame([(row.title, snippet(row.plain_text, 100, args.lines))], "title string, text string")


def cartographer(corpus: Corpus, args) -> DataFrame:
    if not args.space:
        raise ValueError("cartographer needs --space")
    _, pages = _space(corpus, args)
    return tree.cartography(pages, tree.tree_edges(pages), links.edges(pages), args.limit)


def benchmark(corpus: Corpus, args) -> DataFrame:
    if not args.snapshot:
        return corpus.snapshots()
    old = corpus.snapshot(args.snapshot)
    empty_list = F.array().cast("array<string>")
    old = old.withColumns({c: F.lit(None).cast("string") if c == "page_type" else empty_list for c in ("page_type", "duplicate_list") if c not in old.columns})
    now = corpus.table("pages")
    rows = overview.compare_overviews(overview.space_overview(old, links.edges(old)), _overview(corpus, now))
    return rows.withColumn("change", change_text(F.col("delta"))).orderBy("space_id", "metric")


def _leaves(parser: argparse.ArgumentParser, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], argparse.ArgumentParser]]:
    below = [a for a in parser._actions if isinstance(a, argparse._SubParsersAction)]
    for name, own in (kv for a in below for kv in a.choices.items()):
        yield from _leaves(own, (*path, name))
    if not below:
        yield path, parser


def reading_commands(page: str, space: str) -> list[list[str]]:
    """Command lines that read, made from the grammar: each command with each choice that it needs, bare and with each
    of its switches.  Pages and spaces are filled in, and a query where one is asked for."""
    fill = {"page_id": [page], "sql": ["select id, title from pages order by id"]}
    out = []
    for path, parser in _leaves(build()):
        if parser.get_default("writes"):
            continue
        lines = [list(path)]
        for a in parser._actions:
            if not a.option_strings and a.nargs is None:
                lines = [[*line, x] for line in lines for x in (a.choices or fill[a.dest])]
        if parser.get_default("needs_space"):
            lines = [[*line, "--space", space] for line in lines]
        switches = [a.option_strings[0] for a in parser._actions if isinstance(a, argparse._StoreTrueAction) and a.dest not in ("json", "quiet")]
        out += lines + [[*line, s] for line in lines for s in switches]
        if not parser.get_default("needs_space") and any("--space" in a.option_strings for a in parser._actions):
            out += [[*line, "--space", space] for line in lines]
    return out


def smoke_test(corpus: Corpus, args) -> DataFrame:
    """Run the reading commands one by one; a row for each with what became of it."""
    page = corpus.table("pages").select("id", "space_id").orderBy("id").head()
    out = []
    for line in reading_commands(page.id if page else "", page.space_id if page else ""):
        try:
            n = len(run(corpus, build().parse_args(["--corpus", corpus.root, *line])).limit(5).collect())
            out.append((" ".join(line), "ok", n))
        except Exception as e:  # noqa: BLE001 - the table says what failed
            out.append((" ".join(line), f"failed: {type(e).__name__}: {e}"[:200], 0))
    return corpus.spark.createDataFrame(out, "command string, status string, rows int")


def build() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioscope")
    parser.add_argument("--corpus", required=True, help="folder of the stored corpus")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(into, name: str, f: Callable, *, space: bool = True, limit: int | None = None, ids_only: bool = False, writes: bool = False, needs_space: bool = False) -> argparse.ArgumentParser:
        p = into.add_parser(name)
        p.set_defaults(run=f, limit=None, ids_only=False, writes=writes, needs_space=needs_space)
        if space:
            p.add_argument("--space")
        if limit is not None:
            p.add_argument("--limit", "-l", type=int, default=limit)
        if ids_only:
            p.add_argument("--ids-only", action="store_true")
        p.add_argument("--json", action="store_true")
        return p

    p = add(commands, "connection", connection, space=False)
    p.add_argument("field", nargs="?", default="status", choices=("status", "email", "url", "token", "repo-url"))
    p.add_argument("value", nargs="?")
    p = add(commands, "spaces", spaces, space=False)
    p.add_argument("action", nargs="?", default="list", choices=("list", "add", "remove", "configured"))
    p.add_argument("rest", nargs="*")
    p.add_argument("--filter", "-f", nargs="*")
    p = add(commands, "sync", sync, writes=True)
    p.add_argument("--hard-refresh", action="store_true")
    p.add_argument("--from-step")
    p.add_argument("--root")
    p.add_argument("--force", action="store_true")
    p = add(commands, "overview", show_overview)
    p.add_argument("--corpus", "--corpus-only", "--total", action="store_true", dest="corpus_only")
    p.add_argument("--quiet", "-q", action="store_true")

    kinds = commands.add_parser("stats").add_subparsers(dest="stat", required=True)
    add(kinds, "authors", authors, limit=100)
    found = kinds.add_parser("links").add_subparsers(dest="links", required=True)
    add(found, "orphans", orphans, limit=100, ids_only=True)
    add(found, "popular", popular, limit=100, ids_only=True)
    add(found, "cross-space", cross_space, limit=100, ids_only=True)
    add(found, "incoming", incoming, limit=100, ids_only=True).add_argument("page_id")
    add(kinds, "duplicates", duplicate_pages, limit=100, ids_only=True).add_argument("--fuzziness", type=float, default=1.0)
    p = add(kinds, "empty", empty, limit=100, ids_only=True)
    p.add_argument("kind", choices=("blanks", "wordless", "stubs"))
    p.add_argument("--min-age", type=int)
    p.add_argument("--no-structural-value", "-nsv", action="store_true")
    p.add_argument("--clickable", action="store_true")
    p = add(kinds, "children", children, limit=100, ids_only=True)
    p.add_argument("page_id")
    p.add_argument("--max-depth", type=int)

    kinds = commands.add_parser("sql").add_subparsers(dest="sql_command", required=True)
    p = add(kinds, "query", sql_query, space=False)
    p.add_argument("sql")
    p.add_argument("--clickable", action="store_true")
    add(kinds, "columns", sql_columns, space=False).add_argument("--table", default="pages")

    p = add(commands, "labels", label_command, limit=50)
    p.add_argument("action", nargs="?", default="list", choices=("list", "mentions", "similar", "redundant", "add", "remove", "merge"))
    p.add_argument("rest", nargs="*")
    p = add(commands, "excerpts", excerpt_command, limit=50, ids_only=True)
    p.add_argument("action", nargs="?", default="list", choices=("list", "add", "remove"))
    p.add_argument("rest", nargs="*")
    p.add_argument("--sources-only", "-s", action="store_true")
    p.add_argument("--navboxes-only", "-n", action="store_true")
    for p in (commands.choices["labels"], commands.choices["excerpts"]):
        p.add_argument("--dry-run", action="store_true")
    p = add(commands, "move-pages", move, space=False, writes=True)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--quiet", "-q", action="store_true")
    p.add_argument("parent")
    p.add_argument("pids", nargs="+")
    p = add(commands, "preview", preview, space=False)
    p.add_argument("page_id")
    p.add_argument("--lines", "-l", type=int, default=20)
    add(commands, "cartographer", cartographer, limit=25, needs_space=True)
    p = add(commands, "benchmark", benchmark, space=False)
    p.add_argument("--snapshot")
    p.add_argument("--quiet", "-q", action="store_true")
    add(commands, "smoke-test", smoke_test, space=False, writes=True)  # not one of its own commands
    return parser


def run(corpus: Corpus, args) -> DataFrame:
    rows = args.run(corpus, args)
    if args.limit is not None:
        rows = rows.limit(args.limit)
    if args.ids_only:
        rows = rows.select(next(c for c in ("id", "target", "space_id") if c in rows.columns))
    return rows


def show(rows: DataFrame, quiet: bool = False) -> None:
    """Every row and every character, a line a row; rows come partition by partition."""
    if not quiet:
        print(" | ".join(rows.columns))
    for r in rows.toLocalIterator():
        print(" | ".join("" if x is None else str(x).replace("\n", "\\n") for x in r))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build().parse_args(argv)
    spark = spark or SparkSession.builder.appName("folioscope").getOrCreate()
    try:
        rows = run(Corpus(spark, args.corpus), args)
        if args.json:
            for line in rows.toJSON().toLocalIterator():
                print(line)
        else:
            show(rows, quiet=getattr(args, "quiet", False))
    except (ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
