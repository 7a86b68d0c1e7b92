"""Further queries of the catalog: stored tables, lookups, reports, lexical signals, presentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import present as P
from ..functions import text as X
from ..operators import duplicates, excerpts, explore, lexical, stats
from ..operators import tree as G
from ..operators import types as Y
from ..schema import BASE_COLUMNS
from ..sources import store, tables
from ..storage import materialise
from . import adapter as A
from .catalog import _SHINGLES, query
from .passthrough import query as run_sql


@query(f"WITH {A.CORPUS_SQL} SELECT title, version FROM corpus WHERE id = '21'")
def q_lookup(spark, d):
    return tables.lookup(A.corpus(spark, d, "id", "title", "version"), "21", "title", "version")


@query("SELECT column_name AS name FROM (DESCRIBE documents)")
def q_columns(spark, d):
    rows = A.table(spark, d, "documents")
    return spark.createDataFrame([(c,) for c in rows.columns], "name string")


@query(f"WITH {A.CORPUS_SQL} SELECT id, CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'new' ELSE title END AS title, CASE WHEN n % 3 = 0 THEN 99 ELSE version END AS version FROM corpus")
def q_update_fields(spark, d):
    pages = A.corpus(spark, d, "id", "n", "title", "version")
    new = pages.where("n % 3 = 0").select("id", F.when(F.col("n") % 2 == 0, "new").alias("title"), F.lit(99).alias("version"))
    return tables.update_fields(pages, new).select("id", "title", "version")


@query("SELECT 1 + i AS n, CAST(i AS STRING) AS space_id FROM range(3) t(i) UNION ALL SELECT 4, 'INVALID'")
def q_resolve_space(spark, d):
    spaces = A.spaces(spark)
    found = [stats.resolve_space(spaces, x).withColumn("n", F.lit(i).cast("long")) for i, x in enumerate(("0", "s1", "SPACE 2", "nowhere"), 1)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("SELECT CAST(i AS STRING) AS id FROM range(3) t(i) WHERE i <> 0")
def q_filter_spaces(spark, d):
    return stats.filter_spaces(A.spaces(spark), ["s1", "SPACE 2"]).select("id")


@query(f"WITH {A.CORPUS_SQL} SELECT id, title, version, last_modified, space_id, length(html) AS n_html, array_to_string(child_list, ',') AS children FROM corpus")
def q_dehydrated(spark, d):
    pages = A.corpus(spark, d).withColumns({"tiny_link": F.lit(None).cast("string"), "retrieved_at": F.lit("2024-01-20T00:00:00Z")})
    return pages.select(*BASE_COLUMNS).select("id", "title", "version", "last_modified", "space_id", F.length("html").cast("long").alias("n_html"), F.array_join("child_list", ",").alias("children"))


@query(f"WITH {A.CORPUS_SQL} SELECT CAST(max(last_modified) AS DATE) AS date FROM corpus")
def q_snapshot_date(spark, d):
    return tables.snapshot_date(A.corpus(spark, d, "last_modified").withColumnRenamed("last_modified", "retrieved_at"))


@query(f"WITH {A.CORPUS_SQL}, e AS (SELECT max(id) AS parent, c AS child FROM (SELECT id, unnest(child_list) AS c FROM corpus) GROUP BY c) SELECT child, parent FROM e")
def q_parent_map(spark, d):
    return G.parent_map(G.tree_edges(A.corpus(spark, d, "id", "child_list"))).select("child", "parent")


@query(f"WITH {A.CORPUS_SQL} SELECT id, CASE WHEN n % 2 = 0 THEN array_to_string(list_sort(labels), ',') ELSE '' END AS labels FROM corpus")
def q_full_labels(spark, d):
    pages = A.corpus(spark, d, "id", "n", "labels")
    found = pages.where("n % 2 = 0").select("id", F.explode("labels").alias("label"))
    return tables.full_labels(found.unionByName(found), pages).select("id", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {A.CORPUS_SQL} SELECT id, 'https://w/wiki' || '/x/' || id || '/' AS link FROM corpus")
def q_with_links(spark, d):
    pages = A.corpus(spark, d, "id").withColumn("tiny_link", F.concat(F.lit("/x/"), "id"))
    return tables.with_links(pages.select("id"), pages, "https://w/").select("id", "link")


_EXCERPTS = f"{A.CORPUS_SQL}, x AS (SELECT id, title, unnest(excerpts) AS type FROM corpus)"


@query(f"WITH {_EXCERPTS} SELECT id, title, count(*) FILTER (WHERE type = 'excerpt') AS n_excerpts, count(*) FILTER (WHERE type = 'navbox') AS n_navboxes, count(*) AS n_sources, 'a' AS names FROM x GROUP BY id, title")
def q_excerpt_sources(spark, d):
    return excerpts.excerpt_list(A.corpus(spark, d, "id", "title", "excerpts"), sources_only=True)


@query(f"WITH {_EXCERPTS} SELECT id, title, CAST(0 AS BIGINT) AS n_excerpts, count(*) AS n_navboxes, count(*) AS n_sources, 'a' AS names FROM x WHERE type = 'navbox' GROUP BY id, title")
def q_excerpt_navboxes(spark, d):
    return excerpts.excerpt_list(A.corpus(spark, d, "id", "title", "excerpts"), navboxes_only=True)


@query(f"WITH {A.CORPUS_SQL} SELECT id, array_to_string(list_sort(list_distinct(list_concat(excerpts, CASE WHEN n % 8 = 1 THEN ['zz'] ELSE [] END))), ',') AS types FROM corpus WHERE len(excerpts) > 0")
def q_merged_excerpts(spark, d):
    pages = A.corpus(spark, d, "id", "n", "excerpts")
    more = pages.where("n % 8 = 1").select("id", F.array(F.struct(F.lit("zz").alias("type"), F.lit("a").alias("name"), F.lit(False).alias("is_source"), F.lit("1").alias("source_id"))).alias("excerpts"))
    merged = excerpts.merged_excerpts(pages.select("id", "excerpts"), more, more)
    return merged.select("id", F.array_join(F.transform("excerpts", lambda x: x["type"]), ",").alias("types"))


#: Storage markup made from documents, in both dialects: each offers an excerpt, a navigation box or nothing, and shows that of
#: the document with half its id, named by title, with or without a space.
_WORDS = ("regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ')", "regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')")
_NAV = '<ac:structured-macro ac:name="contentbylabel"><ac:parameter ac:name="name">no</ac:parameter></ac:structured-macro>'
_MARKUP = (
    "concat('<h1>Page ', doc_id, '</h1><p>', {words}, '</p>', CASE WHEN doc_id % 3 < 2 THEN concat('<ac:structured-macro ac:name=\"excerpt\"><ac:parameter ac:name=\"name\">Box  ', doc_id, '</ac:parameter>', "
    f"CASE WHEN doc_id % 3 = 1 THEN '{_NAV}' ELSE '' END, '<p>in it</p></ac:structured-macro>') ELSE '' END, "
    "'<div><p><ac:structured-macro ac:name=\"excerpt-include\"><ac:parameter ac:name=\"name\">Box  ', {half}, '</ac:parameter><ac:parameter ac:name=\"\"><ac:link><ri:page ri:content-title=\"Page ', {half}, '\"', "
    "CASE WHEN doc_id % 2 = 0 THEN ' ri:space-key=\"EN\"' ELSE '' END, '/></ac:link></ac:parameter></ac:structured-macro></p></div>')"
)


def _macro_pages(spark, d):
    half = "CAST(doc_id DIV 2 AS STRING)"
    return A.spread(A.table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS id", "concat('Page ', doc_id) AS title", "lang AS space_id", "upper(lang) AS key", f"{_MARKUP.format(words=_WORDS[0], half=half)} AS html"))


@query("""
    WITH p AS (SELECT doc_id, upper(lang) AS key, doc_id // 2 AS half, CASE WHEN doc_id % 2 = 0 THEN 'EN' ELSE upper(lang) END AS asked FROM documents),
    s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'navbox' ELSE 'excerpt' END || ':box  ' || doc_id || ':source:' || doc_id AS x FROM p WHERE doc_id % 3 < 2),
    i AS (SELECT p.doc_id, CASE WHEN o.doc_id % 3 = 1 THEN 'navbox' ELSE 'excerpt' END || ':box  ' || o.doc_id || ':shown:' || o.doc_id AS x FROM p JOIN p o ON o.doc_id = p.half AND o.key = p.asked)
    SELECT CAST(p.doc_id AS STRING) AS id, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (FROM s UNION ALL FROM i) e WHERE e.doc_id = p.doc_id), '') AS excerpts FROM p""")
def q_excerpts(spark, d):
    from ..operators.dom import with_facts
    from ..operators.enrich import resolve_excerpts
    from ..operators.links import title_index

    pages = _macro_pages(spark, d)
    spaces = pages.select(F.col("space_id").alias("id"), F.col("key").alias("short_id")).distinct()
    facts = with_facts(pages, only=("sources", "includes")).select("id", "key", "dom.sources", "dom.includes")
    found = resolve_excerpts(facts, title_index(pages.select("id", "title", "space_id"), spaces))
    text = lambda x: F.concat_ws(":", x["type"], F.lower(x["name"]), F.when(x["is_source"], "source").otherwise("shown"), x["source_id"])
    return found.select("id", F.array_join(F.array_sort(F.transform("excerpts", text)), ",").alias("excerpts"))


_TABLE = "concat('<table><tr><td>', {words}, '</td><td> </td><td>5 min</td><td><ri:user/>x y</td></tr></table>')"
_STRUCTURE = (
    "concat('<ac:layout><ac:layout-section><ac:layout-cell><h2>On ', doc_id, '</h2><p>', {words}, '</p><ul><li>one</li><li>two three</li></ul><p>ab <ac:image/></p>', "
    "repeat({table}, CAST(doc_id % 4 AS INT)), '</ac:layout-cell><ac:layout-cell><ul><li>', {words}, '</li></ul><ac:adf-fallback><p>not this one at all</p></ac:adf-fallback><p>12 min of all', "
    "repeat('<ac:image><ri:attachment/></ac:image>', CAST(doc_id % 3 AS INT)), '</p><ac:structured-macro ac:name=\"code\"><ac:plain-text-body><![CDATA[', {lines}, ']]></ac:plain-text-body></ac:structured-macro>"
    "</ac:layout-cell></ac:layout-section></ac:layout>')"
)


_STRUCTURE_FACTS = ("header_count", "header_titles", "words_outside_tables", "images_outside_tables", "minutes_in_tables", "cells", "code_blocks", "code_lines", "paragraphs", "lead_words")


@query(f"""
    WITH w AS (SELECT doc_id, len(regexp_extract_all({_WORDS[1]}, '[A-Za-z]+')) AS n, CAST(doc_id % 4 AS INT) AS t, CAST(doc_id % 3 AS INT) AS im FROM documents),
    u AS (SELECT *, list_filter([CASE WHEN n >= 5 OR n >= 2 THEN n + 3 ELSE 3 END, CASE WHEN n > 0 THEN n END, CASE WHEN im = 0 THEN 4 END], lambda x: x IS NOT NULL) AS units FROM w)
    SELECT CAST(doc_id AS STRING) AS id, CAST(1 AS INT) AS header_count, 'On ' || doc_id AS header_titles, CAST(2 * n + 16 + doc_id % 5 AS INT) AS words_outside, CAST(1 + im AS INT) AS images_outside, t AS minutes_in_tables,
      CAST(4 * t AS INT) AS n_cells, CAST(t * n + 5 * t AS INT) AS cell_words, CAST(1 AS INT) AS code_blocks, CAST(1 + doc_id % 5 AS INT) AS code_lines, CAST(len(units) AS INT) AS n_units, CAST(list_sum(units) AS INT) AS unit_words, CAST(units[1] AS INT) AS lead_words FROM u""")
def q_dom_structure(spark, d):
    from ..operators.dom import with_facts

    words, lines = _WORDS[0], "concat('a', repeat('\\nb', CAST(doc_id % 5 AS INT)))"
    html = _STRUCTURE.format(words=words, table=_TABLE.format(words=words), lines=lines)
    pages = A.spread(A.table(spark, d, "documents").selectExpr("CAST(doc_id AS STRING) AS id", f"{html} AS html", "CAST(NULL AS STRING) AS key"))
    f = with_facts(pages, only=_STRUCTURE_FACTS)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return f.select(
        "id", "dom.header_count", "dom.header_titles", F.col("dom.words_outside_tables").alias("words_outside"), F.col("dom.images_outside_tables").alias("images_outside"), "dom.minutes_in_tables", F.size("dom.cells").alias("n_cells"), total("dom.cells").alias("cell_words"),
        "dom.code_blocks", "dom.code_lines", F.size("dom.paragraphs").alias("n_units"), total("dom.paragraphs").alias("unit_words"), "dom.lead_words",
    )


def _documents(spark, d):
    docs = A.table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("plain_text"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"))
    return pages, docs.select(F.col("doc_id").cast("string").alias("id"), F.array(F.col("n_chars") / 20.0, F.length("lang").cast("double")).alias("vec"))


@query(f"""WITH RECURSIVE {_SHINGLES}, big AS (SELECT d.doc_id, class_id, n_chars FROM documents d JOIN cl USING (doc_id) JOIN w USING (doc_id) WHERE len(w.w) >= 25),
    alike AS (SELECT a, b FROM j WHERE similarity >= 0.85 UNION SELECT b, a FROM j WHERE similarity >= 0.85 UNION SELECT class_id, class_id FROM cl),
    e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM big x JOIN alike ON alike.a = x.class_id JOIN big y ON y.class_id = alike.b WHERE x.doc_id <> y.doc_id AND abs(x.n_chars / 20.0 - y.n_chars / 20.0) <= 0.7),
    c AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.id)
    SELECT id, min(r) AS group_id FROM c GROUP BY id""")
def q_scan_duplicates(spark, d):
    return duplicates.scan_duplicates(*_documents(spark, d))


@query("SELECT CAST(least(label, 3) AS INT) AS cluster, count(*) AS size, round(avg(abs(CAST(embedding[1] AS DOUBLE))), 6) AS mean_prob FROM embeddings GROUP BY 1")
def q_cluster_summary(spark, d):
    return explore.cluster_summary(_clusters(spark, d)).withColumn("mean_prob", F.round("mean_prob", 6))


def _clusters(spark, d):
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.least("label", F.lit(3)).cast("int").alias("cluster"), F.abs(F.col("embedding")[0].cast("double")).alias("prob"))


@query("SELECT cluster, CAST(rank AS INT) AS rank, id, round(prob, 6) AS prob FROM (SELECT CAST(least(label, 3) AS INT) AS cluster, vec_id AS id, abs(CAST(embedding[1] AS DOUBLE)) AS prob, row_number() OVER (PARTITION BY least(label, 3) ORDER BY abs(CAST(embedding[1] AS DOUBLE)) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 8 AND cluster >= 0")
def q_cluster_samples(spark, d):
    return explore.cluster_samples(_clusters(spark, d)).withColumn("prob", F.round("prob", 6))


@query(f"WITH {A.CORPUS_SQL} SELECT coalesce(page_type, 'uncategorized') AS page_type, count(*) AS n FROM corpus GROUP BY 1")
def q_type_distribution(spark, d):
    return explore.type_distribution(A.corpus(spark, d, "page_type").fillna("uncategorized"))


_CONFUSION = "c AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS type, l_returnflag AS page_type, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _confusion(spark, d):
    kind = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END")
    return A.table(spark, d, "lineitem").groupBy(kind.alias("type"), F.col("l_returnflag").alias("page_type")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CONFUSION}, t AS (SELECT type, sum(n) AS support, sum(n) FILTER (WHERE type = page_type) AS hit FROM c GROUP BY type), s AS (SELECT page_type, sum(n) AS said FROM c GROUP BY page_type)
    SELECT type, round(hit / said, 6) AS precision, round(hit / support, 6) AS recall, round(2 * (hit / said) * (hit / support) / (hit / said + hit / support), 6) AS f1, CAST(support AS BIGINT) AS support FROM t JOIN s ON page_type = type""")
def q_classification_report(spark, d):
    return explore.classification_report(_confusion(spark, d)).select("type", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_CONFUSION} SELECT type, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE page_type = '{x}'), 0) AS BIGINT) AS {x}" for x in "ANR") + " FROM c GROUP BY type")
def q_confusion_matrix(spark, d):
    return explore.confusion_matrix(_confusion(spark, d), list("ANR"))


@query("""WITH e AS (SELECT label, i, CAST(embedding[i] AS DOUBLE) + 1 AS v FROM embeddings, range(1, 65) t(i)), m AS (SELECT label, i, avg(v) AS mean FROM e GROUP BY label, i), a AS (SELECT i, avg(v) AS every FROM e GROUP BY i),
    s AS (SELECT label, i, mean, mean / every * i AS score FROM m JOIN a USING (i)) SELECT CAST(label AS STRING) AS type, CAST(i - 1 AS INT) AS pos, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, i) AS k FROM s) WHERE k <= 5""")
def q_class_features(spark, d):
    rows = A.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("type"), F.transform("embedding", lambda x: x.cast("double") + 1).alias("vec"))
    return Y.class_features(rows, [float(i) for i in range(1, 65)]).select("type", "pos", F.round("mean", 6).alias("mean"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS type FROM embeddings WHERE vec_id % 3 <> 1 OR vec_id % 5 = 0")
def q_store_vectors(spark, d):
    rows = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 != 1, F.col("embedding")).alias("scaled"), F.lit("old").alias("type"))
    new = rows.where("id % 5 = 0").withColumns({"type": F.lit("new"), "scaled": F.array(F.lit(1.0).cast("float"))})
    both = store.store_vectors(rows, new)
    return store.loaded_vectors(both).join(both.select("id", "type"), "id").select("id", "type")


@query("SELECT doc_id, translate(lower(source || ': \"' || lang || chr(39)), '\":' || chr(39), '') AS name FROM documents")
def q_excerpt_name(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.excerpt_name(F.concat("source", F.lit(': "'), "lang", F.lit("'"))).alias("name"))


@query("SELECT p_partkey, CAST((CASE WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'tin') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'economy') THEN 5 ELSE 0 END) AS INT) AS score FROM part")
def q_title_score(spark, d):
    return A.table(spark, d, "part").select("p_partkey", X.title_score(F.col("p_type"), [(["brass", "tin"], 3), (["economy"], 5)]).alias("score"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short, rpad(CASE WHEN length(p_type) > 30 THEN substr(p_type, 1, 29) || '…' ELSE p_type END, 30, ' ') AS padded FROM part")
def q_cut(spark, d):
    return A.table(spark, d, "part").select("p_partkey", P.cut(F.col("p_name"), 8).alias("short"), P.cut(F.col("p_type"), 30, True).alias("padded"))


@query("SELECT o_orderkey, (o_orderkey // 3600) || ':' || lpad(CAST((o_orderkey % 3600) // 60 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') AS duration FROM orders")
def q_duration(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", P.duration(F.col("o_orderkey") + 0.5).alias("duration"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount - 0.05) <= 0.001 THEN 'same' WHEN l_discount > 0.05 THEN 'up' ELSE 'down' END AS change FROM lineitem")
def q_change(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.change(F.col("l_discount") - 0.05).alias("change"))


@query("SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'root' WHEN p_size % 6 = 1 THEN 'top level' WHEN p_size % 6 <= 3 THEN 'mid level' ELSE 'deep' END AS name FROM part")
def q_depth_name(spark, d):
    return A.table(spark, d, "part").select("p_partkey", G.depth_name(F.col("p_size") % 6).alias("name"))


@query("SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR p_retailprice >= 1200")
def q_visible_branches(spark, d):
    nodes = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("depth"), F.col("p_retailprice").alias("avg_words"))
    return G.visible_branches(nodes, 1200).select("p_partkey")


@query("SELECT p_partkey, p_size / 50.0 AS score FROM part WHERE p_size > 40")
def q_gems(spark, d):
    nodes = A.table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("id"), (F.col("p_size") / 100.0).alias("structural"), (F.col("p_size") / 100.0).alias("importance"), (F.col("p_size") > 40).alias("gem"))
    return G.gems(nodes).select("p_partkey", (F.col("structural") + F.col("importance")).alias("score"))


@query("SELECT doc_id, len(j) AS n, j[2] AS second FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE [source, lang, 'a\"b'] END AS j FROM documents)")
def q_json_arrays(spark, d):
    text = F.when(F.col("doc_id") % 4 != 0, F.to_json(F.array("source", "lang", F.lit('a"b'))))
    rows = tables.arrays_from_json(A.table(spark, d, "documents").select("doc_id", text.alias("j")), "j")
    again = tables.arrays_from_json(tables.arrays_to_json(rows, "j"), "j")
    return again.select("doc_id", F.size("j").cast("long").alias("n"), F.col("j")[1].alias("second"))


_TOKENS = r"t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z\-_/0-9]*')) AS word FROM documents)"


@query(f"WITH {_TOKENS} SELECT word, round(log10(count(*) * (1e9 / (SELECT count(*) FROM t))), 6) AS zipf FROM t GROUP BY word")
def q_zipf(spark, d):
    return lexical.zipf_of(_texts(spark, d)).select("word", F.round("zipf", 6).alias("zipf"))


def _texts(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"""WITH {_TOKENS}, z AS (SELECT word, log10(count(*) * (1e9 / (SELECT count(*) FROM t))) - 1 AS zipf FROM t GROUP BY word HAVING count(*) > 1),
    c AS (SELECT doc_id, word, count(*) AS n FROM t WHERE word NOT IN ({", ".join(f"'{w}'" for w in lexical.STOP_WORDS)}) GROUP BY 1, 2),
    m AS (SELECT doc_id, n, coalesce(zipf, 0) AS z FROM c LEFT JOIN z USING (word)),
    s AS (SELECT doc_id, sum(n) AS n, sum(n) FILTER (WHERE z < 1.5) AS j, sum(n) FILTER (WHERE z < 3) AS r, sum(n) FILTER (WHERE z < 4 AND n >= 4) AS f FROM m GROUP BY doc_id)
    SELECT d.doc_id AS id, round(coalesce(j / s.n, 0), 6) AS lexic_jargon_share, round(coalesce(r / s.n, 0), 6) AS lexic_rare_words_share, round(coalesce(f / s.n, 0), 6) AS lexic_topical_focus FROM documents d LEFT JOIN s USING (doc_id)""")
def q_lexical(spark, d):
    texts = _texts(spark, d)
    counts = lexical.corpus_counts(texts)
    zipf = lexical.zipf_of(texts, counts).join(counts.where("n > 1").select("word"), "word").select("word", (F.col("zipf") - 1).alias("zipf"))
    zipf = materialise(zipf, "zipf")
    return lexical.lexical_signals(texts, zipf).select("id", *(F.round(c, 6).alias(c) for c in ("lexic_jargon_share", "lexic_rare_words_share", "lexic_topical_focus")))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (WHERE source ILIKE 'SRC1%') AS n_like, count(*) FILTER (WHERE regexp_matches(source, '^src.*[02468]$')) AS n_even, CAST(sum(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS DOUBLE) AS long FROM documents GROUP BY lang")
def q_sql_dialect(spark, d):
    sql = """select "lang", array_join(sort_array(collect_set(source)), ',') as sources, count(*) filter (where source like 'SRC1%') as n_like,
      count(*) filter (where source glob 'src*[02468]') as n_even, total(iif(n_chars > 500, 1, 0)) as "long" from documents group by lang -- like this"""
    return run_sql(spark, sql, {"documents": A.table(spark, d, "documents")})[0]


@query("WITH RECURSIVE up(id, far) AS (SELECT page_id, 0 FROM pages WHERE page_id IN (SELECT max(page_id) FROM pages) UNION ALL SELECT (id - 1) // 3, far + 1 FROM up WHERE id > 0) SELECT id, far FROM up JOIN pages ON page_id = id")
def q_sql_recursive(spark, d):
    sql = "WITH RECURSIVE up(id, far) AS (SELECT page_id, 0 FROM pages WHERE page_id IN (SELECT max(page_id) FROM pages) UNION ALL SELECT (id - 1) DIV 3, far + 1 FROM up WHERE id > 0) SELECT id, far FROM up JOIN pages ON page_id = id"
    return run_sql(spark, sql, {"pages": A.table(spark, d, "pages")})[0]
