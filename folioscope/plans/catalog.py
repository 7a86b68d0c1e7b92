"""All queries of the library with the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes, duplicates, hierarchy, overview, stats
from ..operators import links as L
from ..operators import tree as G
from . import adapter as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CONTENT = "page_type NOT IN ('meeting_minutes', 'release_notes', 'performance_test')"
_OVERVIEW = f"""
    WITH {A.CORPUS_SQL}, {A.LINKS_SQL},
    r AS (SELECT c.*, {_CONTENT} AS content, NOT EXISTS (SELECT 1 FROM links l WHERE l.target = c.id) AS orphan FROM corpus c),
    s AS (SELECT CASE WHEN grouping(space_id) = 1 THEN '*' ELSE space_id END AS space_id, count(*) AS total_pages, CAST(sum(word_count) AS BIGINT) AS total_words,
      count(*) FILTER (WHERE content) AS content_pages, CAST(sum(word_count) FILTER (WHERE content) AS BIGINT) AS content_words, CAST(sum(link_count) FILTER (WHERE content) AS BIGINT) AS l,
      count(*) FILTER (WHERE content AND link_count = 0) AS dead, count(*) FILTER (WHERE content AND orphan) AS lost,
      count(*) FILTER (WHERE content AND list_contains(eval_notes, 'lead-para-good')) AS leads, count(*) FILTER (WHERE content AND list_contains(excerpts, 'excerpt')) AS reused,
      count(*) FILTER (WHERE content AND len(duplicate_list) > 0) AS dups, count(*) FILTER (WHERE content AND word_count < 25) AS empty,
      count(*) FILTER (WHERE content AND page_type = 'landing_page') AS landing, count(*) FILTER (WHERE content AND list_contains(excerpts, 'navbox')) AS navboxes,
      count(*) FILTER (WHERE content AND page_type = 'canonical_intro') AS hubs FROM r GROUP BY GROUPING SETS ((space_id), ()))
    SELECT space_id, total_pages, total_words, content_pages, content_words, round(1 - coalesce(dead / nullif(content_pages, 0), 0), 4) AS non_dead_ends_share,
      round(1 - coalesce(lost / nullif(content_pages, 0), 0), 4) AS non_orphans_share, round(coalesce(l / nullif(content_words, 0), 0), 4) AS link_density,
      round(coalesce(leads / nullif(content_pages, 0), 0), 4) AS lead_paras_good_share, round(coalesce(reused / nullif(content_pages, 0), 0), 4) AS excerpts_and_reuse_share,
      round(1 - coalesce((dups + empty) / nullif(content_pages, 0), 0), 4) AS non_junk_pages_share, round(coalesce(landing / nullif(content_pages, 0), 0), 4) AS landing_page_coverage,
      round(coalesce(navboxes / nullif(content_pages, 0), 0), 4) AS navbox_coverage, round(coalesce(hubs / nullif(content_pages, 0), 0), 4) AS hub_coverage FROM s"""
_FOR_OVERVIEW = ("id", "space_id", "page_type", "word_count", "link_count", "eval_notes", "excerpts", "duplicate_list")


@query(_OVERVIEW)
def q_overview_space(spark, d):
    return overview.space_overview(A.corpus(spark, d, *_FOR_OVERVIEW), A.links(spark, d))


@query(f"SELECT * FROM ({_OVERVIEW}) WHERE space_id = '*'")
def q_overview_corpus(spark, d):
    return q_overview_space(spark, d).where("space_id = '*'")


_TYPES = ["meeting_minutes", "release_notes", "landing_page", "canonical_intro", "solution_docs", "performance_test", "uncategorized"]


@query(f"WITH {A.CORPUS_SQL} SELECT space_id, " + ", ".join(f"count(*) FILTER (WHERE page_type = '{t}') AS {t}" for t in _TYPES) + " FROM corpus GROUP BY space_id")
def q_type_breakdown(spark, d):
    return overview.type_breakdown(A.corpus(spark, d, "space_id", "page_type"), _TYPES)


@query(f"WITH {A.CORPUS_SQL} SELECT id, page_type FROM corpus WHERE {_CONTENT}")
def q_content_filter_nulls(spark, d):
    return overview.content_pages(A.corpus(spark, d, "id", "page_type"))


@query(f"WITH {A.CORPUS_SQL} SELECT id FROM corpus WHERE word_count = 0 AND length(html) < 50 UNION ALL SELECT 'documents:' || CAST(doc_id AS STRING) FROM documents WHERE length(text) < 50")
def q_blank(spark, d):
    short = A.table(spark, d, "documents").select(F.concat(F.lit("documents:"), F.col("doc_id").cast("string")).alias("id"), F.lit(0).alias("word_count"), F.col("text").alias("html"))
    return stats.blank_pages(A.corpus(spark, d, "id", "word_count", "html").unionByName(short)).select("id")


@query(f"WITH {A.CORPUS_SQL} SELECT id, space_id FROM corpus WHERE word_count = 0")
def q_wordless(spark, d):
    return stats.wordless_pages(A.corpus(spark, d, "id", "space_id", "word_count", "html")).select("id", "space_id")


@query(f"WITH {A.CORPUS_SQL} SELECT id, title, word_count FROM corpus WHERE word_count > 0 AND word_count < 25")
def q_stubs(spark, d):
    return stats.stubs(A.corpus(spark, d, "id", "title", "word_count"))


@query(f"WITH {A.CORPUS_SQL} SELECT id, CASE WHEN has_link_tree AND len(child_list) > 0 AND link_count > 5 THEN 'landing page' WHEN has_link_tree THEN 'has child-macro' WHEN len(child_list) > 0 THEN 'candidate' ELSE '-' END AS value FROM corpus")
def q_structural_value(spark, d):
    return A.corpus(spark, d, "id", "child_list", "has_link_tree", "link_count").select("id", stats.structural_value(F.col("child_list"), F.col("has_link_tree"), F.col("link_count")).alias("value"))


@query(f"WITH {A.CORPUS_SQL} SELECT id FROM corpus WHERE date_diff('day', CAST(substr(last_modified, 1, 10) AS DATE), DATE '2024-02-01') >= 200")
def q_stale(spark, d):
    return stats.stale(A.corpus(spark, d, "id", "last_modified"), F.lit("2024-02-01").cast("date"), 200).select("id")


@query(f"WITH {A.CORPUS_SQL} SELECT id, list_contains(labels, 'mod1') AS has_label FROM corpus WHERE list_contains(labels, 'mod1') OR contains(lower(title), 'mod1')")
def q_label_mentions(spark, d):
    return stats.label_mentions(A.corpus(spark, d, "id", "labels", "title").withColumnRenamed("title", "plain_text"), "mod1")


@query(f"WITH {A.CORPUS_SQL} SELECT label, count(*) AS n_pages FROM (SELECT unnest(labels) AS label FROM corpus) GROUP BY label")
def q_label_counts(spark, d):
    return stats.label_counts(A.corpus(spark, d, "labels"))


_RUNS = """runs AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, g, role ORDER BY turn) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations))"""


def _histories(spark, d):
    rows = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("v"))
    return rows.select(F.col("conv_id").alias("id"), X.squash_runs(F.transform("v", lambda x: x["role"])).alias("authors"))


@query(f"WITH {_RUNS} SELECT conv_id AS id, string_agg(role, ',' ORDER BY turn) AS authors FROM runs WHERE k <= 3 GROUP BY conv_id")
def q_author_squash(spark, d):
    return _histories(spark, d).select("id", F.array_join("authors", ",").alias("authors"))


@query(f"WITH {_RUNS} SELECT role AS author, count(*) AS n_edits FROM runs WHERE k <= 3 GROUP BY role")
def q_top_authors(spark, d):
    return stats.top_authors(_histories(spark, d))


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'x' || n_nationkey ELSE n_name END AS author, count(*) AS n FROM conversations JOIN nation ON turn % 25 = n_nationkey GROUP BY 1")
def q_author_history(spark, d):
    versions = A.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("pos"), (F.col("turn") % 25).cast("string").alias("author_id"))
    names = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("author_id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("x"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name")).alias("name_normalized"))
    return stats.author_history(versions, names).select(F.explode("authors").alias("author")).groupBy("author").agg(F.count("*").alias("n"))


_POPULAR = f"""WITH {A.LINKS_SQL}, {A.CORPUS_SQL}, {A.SPACES_SQL}, t AS (SELECT key, target, count(*) AS n_links FROM links WHERE @ GROUP BY key, target ORDER BY n_links DESC, key, target LIMIT 100)
    SELECT t.key, target, n_links, coalesce(title, target) AS title, coalesce(alias, t.key) AS space FROM t LEFT JOIN corpus ON corpus.id = target LEFT JOIN spaces ON short_id = t.key"""


@query(_POPULAR.replace("@", "TRUE"))
def q_popular_links(spark, d):
    return L.popular_links(A.links(spark, d), A.corpus(spark, d, "id", "title"), A.spaces(spark))


@query(_POPULAR.replace("@", "key = 'S1'"))
def q_popular_links_space(spark, d):
    return L.popular_links(A.links(spark, d), A.corpus(spark, d, "id", "title"), A.spaces(spark), key="S1")


@query(f"WITH {A.LINKS_SQL} SELECT DISTINCT src, space_id FROM links WHERE target = '21'")
def q_incoming(spark, d):
    return L.incoming(A.links(spark, d), "21")


@query(f"WITH {A.LINKS_SQL} SELECT target, count(*) AS n_in FROM links GROUP BY target")
def q_incoming_counts(spark, d):
    return L.incoming_counts(A.links(spark, d))


@query(f"WITH {A.CORPUS_SQL}, {A.LINKS_SQL} SELECT id, space_id FROM corpus WHERE id NOT IN (SELECT target FROM links)")
def q_orphans(spark, d):
    return L.orphans(A.corpus(spark, d, "id", "space_id"), A.links(spark, d))


@query(f"WITH {A.CORPUS_SQL}, {A.LINKS_SQL}, o AS (SELECT space_id, id NOT IN (SELECT target FROM links) AS lost FROM corpus) SELECT space_id, count(*) FILTER (WHERE lost) AS n_orphans, count(*) AS n_pages, round(100.0 * count(*) FILTER (WHERE lost) / count(*), 4) AS pct FROM o GROUP BY space_id")
def q_orphan_pct(spark, d):
    return L.orphan_share(A.corpus(spark, d, "id", "space_id"), A.links(spark, d))


@query(f"""WITH {A.LINKS_SQL}, p AS (SELECT space_id, key, count(*) AS n FROM links GROUP BY 1, 2)
    SELECT space_id, CAST(coalesce(sum(n) FILTER (WHERE space_id = key), 0) AS BIGINT) AS n_self, CAST(coalesce(sum(n) FILTER (WHERE space_id <> key), 0) AS BIGINT) AS n_cross, string_agg(key || '=' || n, ',' ORDER BY key) AS targets FROM p GROUP BY space_id""")
def q_cross_space(spark, d):
    out = L.cross_space(A.links(spark, d), F.col("space_id"))
    return out.select("space_id", "n_self", "n_cross", F.array_join(F.transform(F.array_sort(F.map_entries("by_target")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("targets"))


_TITLES = """CASE page_id % 10 WHEN 3 THEN 'Part: ' || @ WHEN 6 THEN @ || ']' WHEN 7 THEN 'x]y ' || @ WHEN 9 THEN '] ' || @ ELSE @ END"""


@query("""WITH p AS (SELECT page_id, (""" + _TITLES.replace("@", "regexp_extract(html, '<title>(.*?)</title>', 1)") + """) AS title FROM pages), t AS (SELECT trim(title) AS title, max(page_id) AS page_id FROM p GROUP BY 1),
    f AS (SELECT page_id AS id, CASE WHEN page_id % 4 <> 1 THEN title ELSE 'nowhere' END || ']] end' AS s FROM p), g AS (SELECT id, s, instr(s, ']') AS k FROM f),
    h AS (SELECT id, s, k, substr(s, k + 1, 1) = ']' AND k > 1 AS flag, substr(s, 1, k - 1) AS title FROM g),
    r AS (SELECT h.id, s, flag, substr(s, k + 2) AS rest, 'S:' || coalesce(CAST(t.page_id AS STRING), h.title) AS link FROM h LEFT JOIN t ON flag AND t.title = trim(h.title))
    SELECT CAST(id AS STRING) AS id, 'see [[link to: ' || CASE WHEN flag THEN link || ']]' || rest ELSE 'S:' || s END AS plain_text, CASE WHEN flag THEN link END AS link FROM r""")
def q_link_resolution(spark, d):
    """Titles with a colon keep what follows it; a flag ends at the first two brackets, and one that a bracket breaks is none."""
    title = F.expr(_TITLES.replace("page_id", "n").replace("@", "title"))
    pages = A.corpus(spark, d, "id", "n", "title").withColumns({"space_id": F.lit("0"), "title": title})
    space = spark.range(1).select(F.lit("0").alias("id"), F.lit("S").alias("short_id"))
    texts = pages.select("id", F.concat(F.lit("see [[link to: S:"), F.when(F.col("n") % 4 != 1, F.col("title")).otherwise("nowhere"), F.lit("]] end")).alias("plain_text"))
    return L.resolve_links(texts, L.title_index(pages, space)).select("id", "plain_text", F.get("links_list", F.lit(0)).alias("link"))


_OLD = "SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS version, o_orderstatus AS status FROM orders"
_NEW = "SELECT l_orderkey + 100 AS id, CAST(count(*) AS INT) AS version, CASE WHEN max(l_linenumber) > 3 THEN max(l_linestatus) END AS status FROM lineitem GROUP BY l_orderkey"


def _versions(spark, d):
    old = A.table(spark, d, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderkey % 4 AS INT) AS version", "o_orderstatus AS status")
    status = F.when(F.max("l_linenumber") > 3, F.max("l_linestatus"))
    new = A.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") + 100).alias("id")).agg(F.count("*").cast("int").alias("version"), status.alias("status"))
    return old, new


@query(f"SELECT n.id FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON n.id = o.id WHERE n.version > coalesce(o.version, 0)")
def q_delta(spark, d):
    old, new = _versions(spark, d)
    return changes.delta(new, old)


@query(f"SELECT * FROM ({_OLD}) o WHERE id NOT IN (SELECT id FROM ({_NEW}))")
def q_dead_pages(spark, d):
    old, new = _versions(spark, d)
    return changes.dead_pages(old, new)


@query(f"SELECT coalesce(n.id, o.id) AS id, coalesce(n.version, o.version) AS version, coalesce(n.status, o.status) AS status FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.id = o.id")
def q_merge_upsert(spark, d):
    return changes.merge_rows(*_versions(spark, d))


@query(f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_OLD}) WHERE id NOT IN (SELECT id FROM ({_NEW}))")
def q_replace_rows(spark, d):
    return changes.replace_rows(*_versions(spark, d))


@query("SELECT id, problem FROM (SELECT l_suppkey + 90 AS id, CASE WHEN count(*) > 1 THEN 'duplicate' END AS problem FROM lineitem GROUP BY 1) WHERE problem IS NOT NULL UNION ALL SELECT DISTINCT l_suppkey + 90, 'missing' FROM lineitem WHERE l_suppkey + 90 NOT IN (SELECT s_suppkey FROM supplier)")
def q_check_ids(spark, d):
    wanted = A.table(spark, d, "lineitem").selectExpr("l_suppkey + 90 AS id")
    return stats.check_ids(wanted, A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


_N = lambda p: f"CAST(len(regexp_extract_all(html, '{p}')) AS INT)"


@query(f"SELECT page_id, {_N('<a [^>]*href=')} AS links, {_N('<ul>')} AS bullets, {_N('<h[12]>')} AS headers, {_N('<table>')} AS tables, {_N('</ac:image>')} AS images FROM pages")
def q_link_count_html(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return A.table(spark, d, "pages").select("page_id", n("<a [^>]*href=").alias("links"), n("<ul>").alias("bullets"), n("<h[12]>").alias("headers"), n("<table>").alias("tables"), n("</ac:image>").alias("images"))


@query(f"""WITH t AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Notes 12-03-2024' WHEN 1 THEN 'Notes 2024-03 end' WHEN 2 THEN '2024-Mar-12' WHEN 3 THEN 'v112-03-2024' WHEN 4 THEN 'x 2024/11, y' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS title FROM pages)
    SELECT page_id, regexp_matches(title, '(^|[^0-9])(([0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}})|([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})|([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}})|([0-9]{{4}}[-./][0-9]{{2}}))($|[-\\s_:.,;)])') AS date,
      regexp_matches(title, '(?i)(^|[^0-9])[0-9]{{4}}-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-[0-9]{{2}}($|[-\\s_:.,;)])') AS date_bad, regexp_matches(title, '(^|[^0-9])[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}($|[-\\s_:.,;)])') AS date_reverse FROM t""")
def q_date_in_title(spark, d):
    title = F.expr("CASE n % 6 WHEN 0 THEN 'Notes 12-03-2024' WHEN 1 THEN 'Notes 2024-03 end' WHEN 2 THEN '2024-Mar-12' WHEN 3 THEN 'v112-03-2024' WHEN 4 THEN 'x 2024/11, y' ELSE title END")
    rows = A.corpus(spark, d, "n", "title").select(F.col("n").alias("page_id"), title.alias("title"))
    return rows.select("page_id", *(c.alias(k) for k, c in X.title_dates(F.col("title")).items()))


_KW = ["the", "release", "meeting", "que", "der"]


@query("SELECT doc_id, CAST(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{k}') AS INT)" for k in _KW) + " AS INT) AS hits FROM documents")
def q_kw_hits(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.keyword_hits(F.col("text"), _KW).alias("hits"))


@query(f"WITH {A.CORPUS_SQL} SELECT id, round(link_count / coalesce(nullif(word_count / 100.0, 0), 1), 6) AS density, round(coalesce(link_count / nullif(CAST(word_count AS DOUBLE), 0), 0), 6) AS share FROM corpus")
def q_densities(spark, d):
    return A.corpus(spark, d, "id", "link_count", "word_count").select("id", F.round(X.per_hundred(F.col("link_count").cast("double"), F.col("word_count").cast("double")), 6).alias("density"), F.round(X.share(F.col("link_count"), F.col("word_count")), 6).alias("share"))


@query(f"""WITH {A.CORPUS_SQL}, f AS (SELECT id, word_count AS w, CAST(len(regexp_extract_all(html, '<h[12]>')) AS INT) AS h, link_count AS l FROM corpus)
    SELECT id, array_to_string(list_filter([CASE WHEN w > 3000 THEN 'page-too-long' END, CASE WHEN (h > 0 AND w > 0) OR w > 1000 THEN 'headers-too-few' END, CASE WHEN w > 1000 THEN 'toc-missing' END, CASE WHEN w > 20 AND l > 3 THEN 'lead-para-good' END], lambda x: x IS NOT NULL), ',') AS notes FROM f""")
def q_eval_notes(spark, d):
    c = A.corpus(spark, d, "id", "word_count", "link_count", "html")
    return c.select("id", F.array_join(stats.eval_notes(F.col("word_count"), F.regexp_count("html", F.lit("<h[12]>")), F.lit(False), F.col("word_count"), F.col("link_count")), ",").alias("notes"))


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity) / ln(1 + 1730.5), 6) AS word_count, round(l_quantity / 71, 6) AS code_blocks_lines, 0.0 AS metric_flags FROM lineitem")
def q_signal_scale(spark, d):
    from ..functions.signals import scale

    keys = ("word_count", "code_blocks_lines", "metric_flags")
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(scale(k, F.col("l_quantity")), 6).alias(k) for k in keys))


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({e} AS DOUBLE) AS value FROM lineitem" for c, e in {"quantity": "l_quantity", "discount": "l_discount", "flag": "l_linenumber % 2", "one": "1", "price": "l_extendedprice"}.items())


@query(f"""WITH v AS ({_PROFILE}), s AS (SELECT field, count(*) FILTER (WHERE value = 0) / count(*) AS zero_share, count(DISTINCT value) AS n_distinct, min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
      quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, bool_and(value IN (0, 1)) AS b FROM v GROUP BY field)
    SELECT field, round(zero_share, 6) AS zero_share, n_distinct, min, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p95, 4) AS p95, max, round(mean, 4) AS mean, round(std, 4) AS std,
      CASE WHEN n_distinct = 1 THEN 'constant' WHEN b THEN 'binary' WHEN zero_share > 0.8 THEN 'mostly_zero' WHEN n_distinct <= 8 AND max <= 10 THEN 'small_int' WHEN coalesce(max / nullif(p95, 0), 0) > 3 THEN 'heavy_tail' WHEN min >= 0 AND max <= 1 THEN 'ratio_0_1' ELSE 'other' END AS shape FROM s""")
def q_field_profile(spark, d):
    fields = {"quantity": "l_quantity", "discount": "l_discount", "flag": "l_linenumber % 2", "one": "1", "price": "l_extendedprice"}
    each = F.array(*(F.struct(F.lit(k).alias("field"), F.expr(e).cast("double").alias("value")) for k, e in fields.items()))
    out = stats.field_profile(A.table(spark, d, "lineitem").select(F.inline(each)))
    return out.select("field", F.round("zero_share", 6).alias("zero_share"), "n_distinct", "min", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "p95")), "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "shape")


@query("SELECT CAST(round(i * 0.05, 2) AS DOUBLE) AS threshold, count(*) FILTER (WHERE floor(l_discount * 10 * 1000000) >= round(round(i * 0.05, 2) * 1000000)) AS n_labelled, count(*) FILTER (WHERE floor(l_discount * 10 * 1000000) < round(round(i * 0.05, 2) * 1000000)) AS n_unlabelled, round(100.0 * count(*) FILTER (WHERE floor(l_discount * 10 * 1000000) >= round(round(i * 0.05, 2) * 1000000)) / count(*), 4) AS pct_labelled FROM lineitem, range(2, 19) t(i) GROUP BY i")
def q_threshold_sweep(spark, d):
    return stats.threshold_sweep(A.table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("confidence")))


@query("""WITH e AS (SELECT min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY embedding) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))), 6) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id
    WHERE list_distance(a.embedding, b.embedding) <= 1.11 AND sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))) <= 1.1""")
def q_radius_pairs(spark, d):
    vectors = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return duplicates.radius_pairs(vectors, 1.1).select("a", "b", F.round("distance", 6).alias("distance")).orderBy("distance", "a", "b")


@query()
def q_density_hierarchy(spark, d):
    vectors = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return hierarchy.hierarchical_clusters(vectors).select("id", "cluster", F.round("prob", 6).alias("prob"))


@query("SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings")
def q_vector_classes(spark, d):
    return duplicates.vector_classes(A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


def _texts(spark, d):
    return A.spread(A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_SHINGLES = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)),
    z AS (SELECT doc_id, list_sort(list(s)) AS ss, count(*) AS n FROM g GROUP BY doc_id), cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ss) AS class_id, n FROM z),
    k AS (SELECT class_id AS doc_id, any_value(n) AS n FROM cl GROUP BY class_id), q AS (SELECT g.doc_id, s, n FROM g JOIN k USING (doc_id)),
    j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS similarity FROM q x JOIN q y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)"""


@query(f"WITH {_SHINGLES} SELECT a, b, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.8")
def q_shingle_jaccard(spark, d):
    return duplicates.jaccard_join(_texts(spark, d), 0.8).select("a", "b", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "a", "b")


@query(f"WITH {_SHINGLES} SELECT doc_id AS id, class_id FROM cl")
def q_shingle_classes(spark, d):
    return duplicates.shingle_classes(_texts(spark, d))


@query(f"""WITH RECURSIVE {_SHINGLES}, e AS (SELECT a, b FROM j WHERE similarity >= 0.8 UNION SELECT b, a FROM j WHERE similarity >= 0.8), c AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.id)
    SELECT id, min(r) AS group_id FROM c GROUP BY id""")
def q_dup_groups(spark, d):
    return duplicates.duplicate_groups(duplicates.jaccard_join(_texts(spark, d), 0.8)).select("id", "group_id")


_CLOSURE = f"{A.TREE_SQL}, up AS (SELECT parent AS a, child AS x, 1 AS n FROM tree UNION ALL SELECT up.a, tree.child, n + 1 FROM up JOIN tree ON tree.parent = up.x)"


def _nodes(spark, d):
    return A.corpus(spark, d, "id", "title", "word_count", "page_type", "space_id")


@query(f"WITH RECURSIVE {_CLOSURE} SELECT CAST(page_id AS STRING) AS id, CAST(coalesce(max(n), 0) AS INT) AS depth FROM pages LEFT JOIN up ON up.x = CAST(page_id AS STRING) GROUP BY 1")
def q_depth(spark, d):
    return G.depths(A.corpus(spark, d, "id"), A.tree(spark, d))


@query(f"WITH RECURSIVE {_CLOSURE}, {A.CORPUS_SQL} SELECT x AS descendant, title, CAST(up.n AS INT) AS distance FROM up JOIN corpus ON id = x WHERE a = '1' AND up.n <= 3")
def q_descendants(spark, d):
    return G.descendants(A.corpus(spark, d, "id", "title"), A.tree(spark, d), "1", 3)


_SUBTREE = f"""{_CLOSURE}, {A.CORPUS_SQL}, m AS (SELECT a, count(*) AS n_descendants, coalesce(round_even(avg(word_count) / 10, 0) * 10, 0) AS avg_words FROM up JOIN corpus ON id = x GROUP BY a),
    t AS (SELECT a, page_type, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, page_type) AS k FROM up JOIN corpus ON id = x WHERE page_type IS NOT NULL GROUP BY a, page_type)"""


@query(f"WITH RECURSIVE {_SUBTREE} SELECT m.a AS id, n_descendants, CAST(avg_words AS DOUBLE) AS avg_words, page_type AS common_type FROM m LEFT JOIN t ON t.a = m.a AND k = 1")
def q_subtree_metrics(spark, d):
    return G.subtree_metrics(_nodes(spark, d), A.tree(spark, d))


@query(f"""WITH RECURSIVE {_SUBTREE}, {A.LINKS_SQL}, dep AS (SELECT x, max(n) AS depth FROM up GROUP BY x), j AS (SELECT c.id, c.title, c.page_type, (SELECT count(*) FROM tree WHERE parent = c.id) AS n_children, coalesce(n_descendants, 0) AS n_descendants, coalesce(avg_words, 0) AS avg_words, t.page_type AS common_type,
      (SELECT count(*) FROM links l WHERE l.target = c.id) AS n_in, (SELECT count(*) FROM links l WHERE l.src = c.id) AS n_out, coalesce(depth, 0) AS depth FROM corpus c LEFT JOIN m ON m.a = c.id LEFT JOIN t ON t.a = c.id AND k = 1 LEFT JOIN dep ON dep.x = c.id)
    SELECT id, title, page_type, n_children, n_descendants, CAST(avg_words AS DOUBLE) AS avg_words, common_type, n_in, n_out, CAST(depth AS INT) AS depth, round(n_children + 0.1 * n_descendants + n_in + n_out, 4) AS score, CAST(avg_words * n_descendants AS DOUBLE) AS subtree_words
    FROM j WHERE (n_children > 2 AND n_descendants > 0) OR n_in + n_out > 10 ORDER BY score DESC, id LIMIT 25""")
def q_cartography(spark, d):
    return G.cartography(_nodes(spark, d), A.tree(spark, d), A.links(spark, d)).withColumn("score", F.round("score", 4))


@query("""WITH b AS (SELECT p_partkey, p_size % 5 AS g, p_size AS s, p_retailprice AS r, CAST(p_partkey % 7 AS INT) AS depth FROM part),
    x AS (SELECT p_partkey, g, depth, 0.5 * s / greatest(max(s) OVER w, 1) + 0.3 * r / greatest(max(r) OVER w, 1) + 0.2 AS st, (0.55 * r / greatest(max(r) OVER w, 1) + 0.25 * s / greatest(max(s) OVER w, 1) + 0.2) * greatest(0.6, 1 - 0.08 * depth) AS im FROM b WINDOW w AS (PARTITION BY g)),
    y AS (SELECT g, list_sort(list(st)) AS ls, list_sort(list(im)) AS li, count(*) AS n FROM x GROUP BY g)
    SELECT p_partkey, round(st, 6) AS structural, round(im, 6) AS importance, depth >= 4 AND st >= CASE WHEN n < 3 THEN 0 ELSE ls[CAST(floor(n * 0.6) AS INT) + 1] END AND im >= CASE WHEN n < 3 THEN 0 ELSE li[CAST(floor(n * 0.6) AS INT) + 1] END AS gem FROM x JOIN y USING (g)""")
def q_scores_gems(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("space_id"), F.col("p_size").alias("subtree_words"), F.col("p_retailprice").alias("subtree_quality"), F.col("p_retailprice").alias("n_in"), F.col("p_size").alias("n_out"), F.lit(1).alias("quality"), (F.col("p_partkey") % 7).cast("int").alias("depth"))
    return G.scores(rows).select("p_partkey", F.round("structural", 6).alias("structural"), F.round("importance", 6).alias("importance"), "gem")


@query("SELECT CAST(coalesce(a.k, b.k) AS STRING) AS space_id, CASE WHEN b.k IS NULL THEN 'only_old' WHEN a.k IS NULL THEN 'only_new' ELSE 'matched' END AS status, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'total_pages' END AS metric, CASE WHEN b.k IS NOT NULL THEN a.n END AS old, CASE WHEN a.k IS NOT NULL THEN b.n END AS new, b.n - a.n AS delta FROM (SELECT l_suppkey % 20 AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) a FULL JOIN (SELECT l_partkey % 20 + 5 AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def q_snapshot_diff(spark, d):
    side = lambda k: A.table(spark, d, "lineitem").groupBy(F.expr(k).cast("string").alias("space_id")).agg(F.count("*").alias("total_pages"))
    return overview.compare_overviews(side("l_suppkey % 20"), side("l_partkey % 20 + 5"), ("total_pages",))


_NAMES = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Müller, Jörg ' || c_mktsegment WHEN 1 THEN 'Ana ' || c_name WHEN 2 THEN c_mktsegment ELSE NULL END AS raw FROM customer"


@query(f"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'joerg' || lower(c_mktsegment) || ':mueller' WHEN 1 THEN 'ana:' || lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) WHEN 2 THEN lower(c_mktsegment) ELSE '' END AS name FROM customer")
def q_norm_author(spark, d):
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Müller, Jörg ' || c_mktsegment WHEN 1 THEN 'Ana ' || c_name WHEN 2 THEN c_mktsegment ELSE NULL END")
    return A.table(spark, d, "customer").select("c_custkey", X.author_name(raw).alias("name"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, ' ') OR contains(p_type, '_') THEN replace(replace(translate(replace(lower(trim(p_type)), ' ', '-'), '.,\"', ''''''''), '_', '-'), ' ', '-') ELSE lower(trim(p_type)) END AS label FROM part")
def q_norm_label(spark, d):
    return A.table(spark, d, "part").select("p_partkey", X.label_name(F.col("p_type")).alias("label"))


@query("SELECT doc_id, source AS key, lang || ':' || CAST(doc_id AS STRING) AS target FROM documents")
def q_link_codec(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string")).alias("link"))
    return rows.select("doc_id", X.link_key(F.col("link")).alias("key"), X.link_target(F.col("link")).alias("target"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'excerpt' END AS type, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS is_source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'excerpt:' || source || ':' || CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'consumer' END || ':' || doc_id END AS again FROM documents")
def q_excerpt_codec(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("excerpt::source:1")).otherwise(F.concat(F.lit("excerpt:"), "source", F.when(F.col("doc_id") % 2 == 0, ":source:").otherwise(":consumer:"), F.col("doc_id").cast("string")))
    rows = A.table(spark, d, "documents").select("doc_id", X.excerpt_struct(text).alias("x"))
    return rows.select("doc_id", "x.type", "x.is_source", F.when(F.col("x").isNotNull(), X.excerpt_text(F.col("x"))).alias("again"))


@query("SELECT doc_id, trim(regexp_replace(lower(source || '  ' || lang || chr(10) || ' X '), '\\s+', ' ', 'g')) AS flat FROM documents")
def q_flat_text(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.flat_text(F.concat("source", F.lit("  "), "lang", F.lit("\n X "))).alias("flat"))


@query(f"WITH {A.CORPUS_SQL} SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter(labels, lambda x: x <> 'mod1'), CASE WHEN list_contains(labels, 'mod1') THEN ['merged'] ELSE [] END))), ',') AS labels FROM corpus")
def q_label_merge(spark, d):
    pages = A.corpus(spark, d, "id", "labels")
    actions = changes.label_actions(pages, pages.select("id"), "merge", "mod1", "merged")
    return changes.apply_label_actions(pages, actions).select("id", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {A.TREE_SQL} SELECT child, CASE WHEN parent = '3' THEN '2' ELSE parent END AS parent FROM tree")
def q_move_pages(spark, d):
    tree = A.tree(spark, d)
    plan = changes.move_pages(tree, tree.where("parent = '3'").select(F.col("child").alias("id")), "2")
    return changes.apply_moves(tree, plan).select("child", "parent")


@query(f"WITH {A.CORPUS_SQL} SELECT id, CASE WHEN link_count > 5 THEN version ELSE 7 END AS processed_version FROM corpus")
def q_mark_processed(spark, d):
    pages = A.corpus(spark, d, "id", "link_count", "version").withColumn("processed_version", F.lit(7))
    return changes.mark_processed(pages, pages.where("link_count > 5").select("id")).select("id", "processed_version")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_event_windows(spark, d):
    from ..streaming.ingest import event_windows

    return event_windows(A.table(spark, d, "events"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def q_sql_windows(spark, d):
    A.table(spark, d, "orders").createOrReplaceTempView("fs_orders")
    return spark.sql("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3, lag(o_orderstatus) OVER w AS before FROM fs_orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 99")
def q_sql_setops(spark, d):
    c, s = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), A.table(spark, d, "supplier").select("s_nationkey")
    return c.intersect(s).exceptAll(A.table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")).unionAll(spark.range(1).select(F.lit(99)))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def q_sql_json(spark, d):
    return A.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("k"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def q_sql_cube(spark, d):
    return A.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND c_name LIKE 'C%' GROUP BY n_name HAVING count(*) > 5")
def q_sql_joins(spark, d):
    o, c, n = (A.table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.where("o_orderdate >= timestamp '1995-01-01'").join(c.where(F.col("c_name").ilike("c%")), o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n_orders > 5")


def _facts(spark, d, html=None, only=None):
    """Facts of the pages, or of other markup made from them: all, or those named."""
    from ..operators.dom import with_facts

    pages = A.spread(A.corpus(spark, d, "id", "html", "space_id"))
    pages = pages.select("id", (F.col("html") if html is None else html).alias("html"), F.upper("space_id").alias("key"))
    return with_facts(pages, out="f", only=only).drop("html")


def _unescaped(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')"""


def _shown(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '<[^>]*>'), lambda s: trim({_unescaped('s')}, e' \\t\\n\\r')), lambda s: s <> ''), ' ')"


def _n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^ \\t\\n\\r]+'))"


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_PLAIN_TEXT = f"""
    WITH b AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda x: {_shown('x')}) AS items,
      {_shown("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS head, {_shown("regexp_extract(html, '(?s)</h1>(.*?)</article>', 1)")} AS body FROM pages),
    l AS (SELECT page_id, list_transform(items, lambda x: {{'text': x, 'line': '- ' || x}}) || [{{'text': head, 'line': '[[Heading: ' || head || ']]'}}, {{'text': body, 'line': body}}] AS lines FROM b),
    u AS (SELECT page_id, list_filter(lines, lambda x, i: x.text <> '' AND list_position(list_transform(lines, lambda y: y.line), x.line) = i) AS lines FROM l)
    SELECT CAST(page_id AS STRING) AS id, array_to_string(list_transform(lines, lambda x: x.line), e'\\n') AS plain_text,
      CAST(coalesce(list_sum(list_transform(lines, lambda x: {_n_words('x.text')})), 0) AS INT) AS word_count FROM u"""


@query(_PLAIN_TEXT)
def q_plain_text(spark, d):
    from ..functions.dom import html_nodes
    from ..operators.dom import plain_text
    from ..storage import materialise

    pages = A.spread(A.corpus(spark, d, "id", "html", "space_id")).withColumn("key", F.upper("space_id"))
    return plain_text(materialise(html_nodes(pages), "nodes")).withColumnRenamed("page", "id")


_OPENING = "'<p><b>([^<]*)<br>'"
_LEAD = f"""
    WITH p AS (SELECT page_id, list_filter(regexp_extract_all(regexp_replace({_ARTICLE}, {_OPENING}, '<h2>\\1</h2>', 'g'), '(?s)<p>(.*?)</p>', 1), lambda x: {_n_words('x')} >= 2) AS paras FROM pages)
    SELECT CAST(page_id AS STRING) AS id, '<p>' || replace(replace(replace({_unescaped('paras[1]')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS lead_para,
      CAST(coalesce({_n_words('paras[1]')}, 0) AS INT) AS lead_words, CAST(coalesce(len(regexp_extract_all(paras[1], '<a href=')), 0) AS INT) AS lead_links, CAST(len(paras) AS INT) AS n_paragraphs FROM p"""


@query(_LEAD)
def q_lead_paragraph(spark, d):
    """Prose of the articles, which are the pages' storage bodies; what opens them and is never closed is a header."""
    c = _facts(spark, d, F.expr(f"regexp_replace({_ARTICLE}, {_OPENING}, '<h2>$1</h2>')"), ("lead_para", "lead_words", "lead_links", "paragraphs"))
    return c.select("id", "f.lead_para", "f.lead_words", "f.lead_links", F.size("f.paragraphs").alias("n_paragraphs"))


@query()
def q_signals(spark, d):
    from ..functions.signals import LEXICAL, SIGNAL_KEYS, raw_signals, with_vectors
    from ..operators.dom import with_facts
    from ..operators.lexical import lexical_signals, zipf_of
    from ..schema import STUB_WORDS
    from ..storage import materialise

    c = A.spread(A.corpus(spark, d, "id", "html", "space_id", "title", "child_list")).withColumn("key", F.upper("space_id"))
    c = with_facts(c, out="f")
    raw = raw_signals(F.col("html"), F.col("title"), F.col("f.plain_text"), F.col("f.word_count"), F.col("child_list"), F.col("f"))
    # signals of the page itself are made before the join, so only short rows are moved
    own = materialise(c.select("id", F.col("f.plain_text").alias("text"), F.array(*(raw[k] for k in SIGNAL_KEYS)).alias("own")), "signals")
    texts = own.select("id", "text")
    rows = own.join(lexical_signals(texts, materialise(zipf_of(texts), "zipf")), "id")
    full = F.col("own")[0] >= STUB_WORDS
    signals = {k: F.when(full, F.col(k)).otherwise(0.0) if k in LEXICAL else F.col("own")[i] for i, k in enumerate(SIGNAL_KEYS)}
    return with_vectors(rows, signals).select("id", "raw", "scaled")


@query()
def q_enrich(spark, d):
    from ..operators.enrich import enrich

    base = A.spread(A.corpus(spark, d, "id", "title", "version", "last_modified", "space_id", "html", "child_list")).withColumns({"tiny_link": F.lit(None).cast("string"), "retrieved_at": F.lit("2024-01-20T00:00:00Z")})
    spaces = base.select(F.col("space_id").alias("id")).distinct().withColumn("short_id", F.upper("id"))
    return enrich(base, spaces)


@query()
def q_type_assign(spark, d):
    from ..operators.types import assign_types, fit_types, training_rows

    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("type"))
    model = fit_types(training_rows(e.select("id", "type"), e.select("id", "vec")), trees=20)
    return assign_types(e.select("id", "vec"), model)


_NAME = "small new gizmo"
_FUZZY = f"""
    WITH l AS (SELECT DISTINCT lower(p_name) AS label, '{_NAME}' AS name FROM part WHERE lower(p_name) <> '{_NAME}'),
    t AS (SELECT label, name, list_sort(string_split(label, ' ')) AS ls, list_sort(string_split(name, ' ')) AS ns, greatest(length(label), length(name)) / least(length(label), length(name)) >= 1.5 AS parts FROM l),
    u AS (SELECT *, array_to_string(list_filter(ls, lambda x: list_contains(ns, x)), ' ') AS mid, array_to_string(list_filter(ls, lambda x: NOT list_contains(ns, x)), ' ') AS lo, array_to_string(list_filter(ns, lambda x: NOT list_contains(ls, x)), ' ') AS hi FROM t),
    c AS (SELECT label, 'whole' AS kind, false AS parts, label AS a, name AS b FROM u UNION ALL SELECT label, 'part', true, label, name FROM u WHERE parts
      UNION ALL SELECT label, 'tokens', parts, array_to_string(ls, ' '), array_to_string(ns, ' ') FROM u UNION ALL SELECT label, 'tokens', parts, trim(mid || ' ' || lo), trim(mid || ' ' || hi) FROM u
      UNION ALL SELECT label, 'tokens', parts, mid, trim(mid || ' ' || lo) FROM u WHERE mid <> '' UNION ALL SELECT label, 'tokens', parts, mid, trim(mid || ' ' || hi) FROM u WHERE mid <> ''),
    o AS (SELECT label, kind, parts, CASE WHEN length(a) > length(b) THEN b ELSE a END AS a, CASE WHEN length(a) > length(b) THEN a ELSE b END AS b FROM c),
    w AS (SELECT label, kind, a, b FROM o WHERE NOT parts UNION ALL SELECT label, kind, a, substring(b, greatest(i, 0) + 1, least(length(b), i + length(a)) - greatest(i, 0))
      FROM (SELECT *, unnest(range(1 - length(a), length(b))) AS i FROM o WHERE parts)),
    r AS (SELECT label, kind, max(200.0::DOUBLE * list_last(list_reduce(list_transform(string_split(b, ''), lambda y: [ord(y)]),
        lambda row, y: [0] || list_transform(range(1, length(a) + 1), lambda j: greatest(row[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: ord(a[k]) = y[1]), lambda k: row[k] + 1)), 0))),
        list_transform(range(0, length(a) + 1), lambda j: 0))) / (length(a) + length(b))) AS score FROM w GROUP BY label, kind),
    s AS (SELECT u.label, max(CASE r.kind WHEN 'whole' THEN r.score WHEN 'part' THEN 0.9::DOUBLE * r.score ELSE 0.95::DOUBLE * CASE WHEN parts THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN mid <> '' AND (lo = '' OR hi = '') THEN 100 ELSE r.score END END) AS score
      FROM u JOIN r ON u.label = r.label GROUP BY u.label)
    SELECT label, round(score, 6) AS score FROM s WHERE score >= 60 ORDER BY score DESC, label LIMIT 40"""


@query(_FUZZY)
def q_fuzzy_labels(spark, d):
    from ..functions.fuzzy import nearest_labels

    return nearest_labels(A.table(spark, d, "part").select(F.lower("p_name").alias("label")), _NAME, 60, 40).withColumn("score", F.round("score", 6))


@query()
def q_redundant_labels(spark, d):
    from ..functions.fuzzy import redundant_labels

    return redundant_labels(A.table(spark, d, "part").groupBy(F.concat(F.lower("p_type"), F.when(F.col("p_partkey") % 3 == 0, " s").otherwise("")).alias("label")).agg(F.count("*").alias("pages")), 80)
