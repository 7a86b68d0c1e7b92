"""The facts of pages from node tables against a plain walk over element trees."""

import random

from folioscope.functions.dom import html_nodes, tokens
from folioscope.operators import dom

from . import plain_dom


def nodes_of(spark, tmp_path, pages):
    rows = spark.createDataFrame([(str(i), h, k) for i, (h, k) in enumerate(pages)], "id string, html string, key string").repartition(4)
    path = str(tmp_path / "nodes")
    html_nodes(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def facts(spark, tmp_path, pages):
    """The facts of pages (html, space key), in their order."""
    found = {int(r.page): r.asDict(recursive=True) for r in dom.page_facts(nodes_of(spark, tmp_path, pages)).collect()}
    return [{k: v for k, v in found[i].items() if k != "page"} for i in range(len(pages))]


def _page(r):
    """Random markup with all that facts look at, unclosed and stray tags, blanks of all kinds and entities."""
    words = ["one", "two", "5 min", "12 Min of", "x", " ", "\n", "A &amp; B", "&lt;b&gt;", " ", "7", "min", "über all", "[[link to: S:T]]", "a\r\nb", ""]
    macros = ["code", "excerpt", "excerpt-include", "contentbylabel", "drawio", "panel"]
    tags = ["p", "p", "p", "ul", "li", "table", "tr", "td", "h1", "h2", "h3", "div", "b", "pre", "ac:layout-cell", "ac:adf-fallback", "ol", "ac:plain-text-body"]

    def piece(depth):
        k = r.random()
        if depth > 5 or k < 0.35:
            return " ".join(r.choice(words) for _ in range(r.randint(1, 6)))
        if k < 0.42:
            return r.choice(["<br>", "<br/>", "<ri:user/>", '<ac:image><ri:attachment ri:filename="x"/></ac:image>', "</p>", "</div>", "<p>", "<td>", '<img src="a&quot;b\'c">', "<![CDATA[a\nb]]>", "<script>var x = '<p>no</p>';</script>", "<style>p {}</style>"])
        if k < 0.5:
            return f'<ac:link><ri:page ri:content-title="{r.choice(["T", "A &amp; B", "Other"])}"{r.choice(["", " ri:space-key=" + chr(34) + "K" + chr(34)])}/></ac:link>' + r.choice(["", ", and", " "])
        if k < 0.62:
            name = r.choice(macros)
            inner = "".join(piece(depth + 1) for _ in range(r.randint(0, 3)))
            param = r.choice(["", '<ac:parameter ac:name="name">box <b>1</b></ac:parameter>', '<ac:parameter ac:name="">z</ac:parameter>', '<ac:parameter ac:name="name"></ac:parameter>'])
            return f'<ac:structured-macro ac:name="{name}">{param}{inner}</ac:structured-macro>'
        tag = r.choice(tags)
        end = f"</{tag}>" if r.random() < 0.9 else ""
        return f'<{tag}{r.choice(["", " class=" + chr(34) + "c" + chr(34)])}>' + "".join(piece(depth + 1) for _ in range(r.randint(0, 4))) + end

    return "".join(piece(0) for _ in range(r.randint(0, 7)))


def test_random_pages(spark, tmp_path):
    r = random.Random(11)
    pages = [(_page(r), r.choice(["S", None])) for _ in range(600)] + [(None, "S"), ("", None), ("   ", "S"), ("<p>", "S"), ("</p>x", None)]
    got = facts(spark, tmp_path, pages)
    wrong = []
    for (html, key), g in zip(pages, got, strict=True):
        want = plain_dom.facts(html, key)
        wrong += [(k, g[k], want[k], html) for k in want if g[k] != want[k]]
    assert not wrong, (len(wrong), wrong[:3])
    clean = {int(x.page): x.html for x in dom.clean_html(nodes_of(spark, tmp_path, [(h, None) for h, _ in pages])).collect()}
    wrong = [(clean[i], plain_dom.clean_html(html), html) for i, (html, _) in enumerate(pages) if clean[i] != plain_dom.clean_html(html)]
    assert not wrong, (len(wrong), wrong[:3])


def test_a_hundred_thousand_levels(spark, tmp_path):
    tags = {"p": 100_000, "td": 100_000, "ul": 100_000, "table": 100_000, "h1": 2_000}  # each of nested headers is listed with all that it holds
    pages = [f"<{t}>x " * n for t, n in tags.items()]
    found = facts(spark, tmp_path, [(p, "S") for p in pages] + [("<p>one two " + p + "</p>", "S") for p in pages])
    for (tag, n), one, two in zip(tags.items(), found[: len(pages)], found[len(pages) :], strict=True):
        assert one["words_outside_tables"] == (0 if tag == "table" else n) and two["lead_words"] == n + 2
        assert len(one["cells"]) == (n if tag == "td" else 0) and one["header_count"] == (n if tag == "h1" else 0)
    clean = {r.page: r.html for r in dom.clean_html(nodes_of(spark, tmp_path, [(p, None) for p in pages])).collect()}
    assert [clean[str(i)].count(f"<{t}>") for i, t in enumerate(tags)] == list(tags.values())


def test_intervals():
    rows = tokens("<p>a<b>c</b></p><i/>d</x>", None)
    assert [(x[0], x[1], x[2], x[4], x[6]) for x in rows] == [(0, 10, None, "[document]", None), (1, 6, 0, "p", None), (2, 2, 1, None, "a"), (3, 5, 1, "b", None), (4, 4, 3, None, "c"), (7, 8, 0, "i", None), (9, 9, 0, None, "d")]


LAYOUT = (
    "<ac:layout><ac:layout-section><ac:layout-cell><h2>Title</h2><p>First <em>words</em> of the page</p><ul><li>one</li><li>two</li></ul>"
    '<p>ab <ac:image><ri:attachment ri:filename="x.png"/></ac:image></p><ac:adf-fallback><p>not this one at all</p></ac:adf-fallback>'
    '<p><ac:structured-macro ac:name="excerpt-include"><ac:parameter ac:name="name">box</ac:parameter><ac:parameter ac:name=""><ac:link><ri:page ri:content-title="Other" ri:space-key="K"/></ac:link></ac:parameter></ac:structured-macro></p>'
    "</ac:layout-cell><ac:layout-cell><p>Second cell of prose here</p></ac:layout-cell></ac:layout-section></ac:layout>"
)


def test_layout_page(spark, tmp_path):
    f = facts(spark, tmp_path, [(LAYOUT, "S")])[0]
    assert f["plain_text"] == "[[Heading: Title]]\nFirst words of the page\n- one\n- two\nab\n[[Excerpt from: Other]]\nSecond cell of prose here"
    assert f["paragraphs"] == [7, 5] and f["lead_words"] == 7 and f["lead_para"] == "<p>First <em>words</em> of the page</p><ul><li>one</li><li>two</li></ul>"
    assert f["includes"] == [{"name": "box", "title": "Other", "space_key": "K"}] and f["sources"] == [] and f["images_outside_tables"] == 1


def test_flags_stay_out_of_all_but_the_text(spark, tmp_path):
    page = '<p>See the page <ac:link><ri:page ri:content-title="A &amp; B"/></ac:link>, and <ac:link><ri:page ri:content-title="C" ri:space-key="ZZ"/></ac:link> too</p><ac:link><ri:user/></ac:link>'
    f = facts(spark, tmp_path, [(page, "S")])[0]
    assert f["plain_text"] == "See the page [[link to: S:A & B]], and [[link to: ZZ:C]] too" and f["word_count"] == 6
    assert "fs:flag" not in f["lead_para"] and "link to" not in f["lead_para"] and f["lead_words"] == 6 and f["words_outside_tables"] == 6
    assert facts(spark, tmp_path, [(page, None)])[0]["plain_text"].startswith("See the page [[link to: A & B]]")


def test_tables_and_code(spark, tmp_path):
    page = (
        "<table><tr><td>5 min</td><td></td><td>a b c d e f</td><td><ri:user/>x</td></tr><tr><td>late <b>120</b> Min of it</td></tr></table><p>out 7 min</p>"
        '<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[a\nb\nc]]></ac:plain-text-body></ac:structured-macro><script>var x = 1;</script>'
        '<ac:structured-macro ac:name="excerpt"><ac:parameter ac:name="name">n</ac:parameter><ac:structured-macro ac:name="contentbylabel"/></ac:structured-macro><ac:structured-macro ac:name="excerpt"><p>x</p></ac:structured-macro>'
    )
    f = facts(spark, tmp_path, [(page, "S")])[0]
    assert f["minutes_in_tables"] == 2 and f["cells"] == [2, 0, 6, 2, 3] and (f["code_blocks"], f["code_lines"]) == (1, 3)
    assert f["sources"] == [{"type": "navbox", "name": "n"}, {"type": "excerpt", "name": "UNNAMED"}] and f["words_outside_tables"] == 8


def test_lines_once_and_empty_pages(spark, tmp_path):
    one, *none = facts(spark, tmp_path, [("<p>a</p><p> a </p><li>a</li><h1>a</h1><h3>a</h3>", "S"), ("", "S"), (None, None)])
    assert (one["plain_text"], one["word_count"]) == ("a\n- a\n[[Heading: a]]", 3)
    for f in none:
        assert (f["plain_text"], f["word_count"], f["paragraphs"], f["lead_para"], f["cells"], f["sources"]) == ("", 0, [], None, [], [])
    page = '<p>a<b> </b></p><div><span></span></div><ac:adf-fallback>x</ac:adf-fallback><ac:structured-macro ac:name="excerpt-include"/>'
    assert dom.clean_html(nodes_of(spark, tmp_path, [(page, None)])).head().html == "<p>a</p><p>[[Excerpt from: Unknown page]]</p>"


def test_lines_headings_and_lists(spark, tmp_path):
    page = '<h1>Top</h1><p>One two <b>three</b></p><ul><li>four</li></ul><p>One two <b>three</b></p><ac:adf-fallback><p>gone</p></ac:adf-fallback><p><ac:link><ri:page ri:content-title="T"/></ac:link></p>'
    f = facts(spark, tmp_path, [(page, "KEY")])[0]
    assert f["plain_text"] == "[[Heading: Top]]\nOne two three\n- four\n[[link to: KEY:T]]"
    assert (f["word_count"], f["lead_words"], f["paragraphs"], f["header_count"]) == (5, 4, [4, 3], 1)


def test_only_the_facts_asked_for_are_made(spark, tmp_path):
    """A query that takes headings and cells moves no page text and sorts no events."""
    nodes = nodes_of(spark, tmp_path, [(LAYOUT, "S"), ("<table><td>a b</td></table><h1>T <b>u</b></h1>", "S")])
    some = dom.page_facts(nodes, ("header_titles", "cells"))
    assert {r.page: (r.header_titles, r.cells) for r in some.collect()} == {"0": ("Title", []), "1": ("Tu", [2])}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1


def test_references_end_with_a_semicolon():
    """Storage markup is XML, where ``&amp`` alone is text; entities, numbers and plain sections stay as they are."""
    page = '<p title="a&b&amp;c">x &amp; y&amp z&lt;&#x27;&#39 & &copy;&nosuch;<![CDATA[a && b &amp;]]></p><h1>cut off&amp;&amp</h1>'
    rows = tokens(page, None)
    assert [x[6] for x in rows if x[6] is not None] == ["x & y&amp z<'&#39 & ©&nosuch;", "a && b &amp;", "cut off&&amp"] and rows[1][5] == {"title": "a&b&c"}
