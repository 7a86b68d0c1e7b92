"""Page functions on small golden pages, fuzzy names, lexical signals, SQL translation, clusters, streams."""

import math
import random

import numpy as np
import pytest

def test_link_titles_with_odd_letters(spark):
    from folioscope.operators.links import resolve_links, title_index

    pages = spark.createDataFrame([("1", "A: B", "s"), ("2", "Same", "s"), ("3", "Same", "t"), ("12", " Same ", "s"), ("9", "B", "~x")], "id string, title string, space_id string")
    spaces = spark.createDataFrame([("s", "S"), ("t", "T"), ("~x", "~X")], "id string, short_id string")
    flags = {"a": "[[link to: S:A: B]] x [[link to: T:Same]]", "b": "[[link to: S:Same]][[link to: S:none]]", "c": "no link", "d": None, "e": "[[link to: ~X:B]] [[link to: S:q]x]]", "f": "[[link to: S:1]]"}
    texts = spark.createDataFrame(list(flags.items()), "id string, plain_text string")
    got = {r.id: (r.plain_text, r.links_list) for r in resolve_links(texts, title_index(pages, spaces)).collect()}
    assert got == {
        "a": ("[[link to: S:1]] x [[link to: T:3]]", ["S:1", "T:3"]), "b": ("[[link to: S:12]][[link to: S:none]]", ["S:12", "S:none"]), "c": ("no link", []), "d": (None, []),
        "e": ("[[link to: ~X:9]] [[link to: S:q]x]]", ["~X:9"]), "f": ("[[link to: S:1]]", ["S:1"]),
    }


def _plain_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def _labels(n=220, seed=4):
    r = random.Random(seed)
    words = ["release", "notes", "team", "ops", "how", "to", "guide", "api", "v2", "design", "q", "meeting-minutes"]
    out = set()
    while len(out) < n:
        t = r.choice([" ", "-"]).join(r.choice(words) for _ in range(r.randint(1, 4)))
        if r.random() < 0.4:
            k = r.randrange(len(t))
            t = t[:k] + r.choice("abz s") + t[k + 1 :]
        out.add(t.strip())
    return sorted(out - {""})


def test_fuzzy_scores_and_their_bound():
    from folioscope.functions import fuzzy as Z

    names = _labels()
    r = random.Random(1)
    for _ in range(4000):
        a, b = r.choice(names), r.choice(names)
        assert Z.ratio(a, b) == _plain_ratio(a, b)
        score = Z.weighted_ratio(a, b)
        for least in (60, 75, 80, 90):
            assert score < least or Z.can_reach(a, b, least)
    tokens = ["no", "ha", "na", "know", "ledge", "base", "chart", "a", "on", "tools", "x"]
    repeated = lambda: r.choice([" ", "  ", "-", "\t"]).join(r.choice(tokens) for _ in range(r.randint(1, 5)))
    pairs = [("no no no", "knowledge-base"), ("ha ha ha", "chart-tools-x"), (" a a", "a-b")] + [(repeated(), repeated()) for _ in range(30_000)]
    refused = 0
    for a, b in pairs:
        score = Z.weighted_ratio(a, b)
        for least in (50, 60, 75, 80, 90):
            fine = Z.can_reach(a, b, least)
            refused += not fine
            assert score < least or fine, (a, b, score, least)
    assert refused > 30_000  # a bound that refuses nothing would be right, too
    assert Z.partial_ratio("abc", "xxabcxx") == 100.0 and Z.weighted_ratio("release notes", "notes release") == 95.0 and Z.weighted_ratio("", "a") == 0.0


def test_redundant_labels_equal_clusters_of_the_whole_vocabulary(spark, monkeypatch):
    from folioscope.functions import fuzzy as Z

    monkeypatch.setattr(Z, "BLOCK_NAMES", 50)
    names = _labels(150, 7)
    rows = [(x, (i * 7) % 23 + 1) for i, x in enumerate(names)]
    ordered = sorted(rows, key=lambda x: (-x[1], x[0]))
    d = np.array([[100 - Z.weighted_ratio(a, b) for b, _ in ordered] for a, _ in ordered])
    label = Z.complete_linkage(d, 20)
    want = sorted((tuple(ordered[i][0] for i in np.flatnonzero(label == k)), int(sum(ordered[i][1] for i in np.flatnonzero(label == k)))) for k in set(label) if (label == k).sum() > 1)
    got = Z.redundant_labels(spark.createDataFrame([*rows, (None, 3)], "label string, pages int"), 80).collect()
    assert sorted((tuple(r.labels), r.total) for r in got) == want and len(want) > 3
    assert [r.total for r in got] == sorted((r.total for r in got), reverse=True)
    near = Z.nearest_labels(spark.createDataFrame([(x,) for x in names], "label string"), "release notes", 75, 5).collect()
    best = sorted(((-Z.weighted_ratio(x, "release notes"), x) for x in names if x != "release notes" and Z.weighted_ratio(x, "release notes") >= 75))[:5]
    assert [(-r.score, r.label) for r in near] == best


def test_lexical_signals(spark):
    from folioscope.operators import lexical

    zipf = spark.createDataFrame([("wiki", 3.5), ("cat", 4.5), ("quark", 2.0)], "word string, zipf double")
    texts = spark.createDataFrame([(1, "The wiki, wiki Wiki wiki cat and quark zzz-9"), (2, None), (3, "the of and")], "id long, text string")
    got = {r.id: tuple(r)[1:] for r in lexical.lexical_signals(texts, zipf).collect()}
    assert got == {1: pytest.approx((1 / 7, 2 / 7, 4 / 7)), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_enriched_signals_are_live(spark):
    from folioscope.functions.signals import SIGNAL_KEYS
    from folioscope.operators.enrich import enrich

    text = " ".join(f"word{i % 7}" for i in range(40))
    rows = [("1", "Meeting notes 12-03-2024", 1, "2024", "s", f"<p>{text}</p>", "/1", "2024", ["2"]), ("2", "Stub", 1, "2024", "s", "<p>few words</p>", "/2", "2024", [])]
    base = spark.createDataFrame(rows, "id string, title string, version int, last_modified string, space_id string, html string, tiny_link string, retrieved_at string, child_list array<string>")
    out = {r.id: dict(zip(SIGNAL_KEYS, r.raw, strict=True)) | {"scaled": r.scaled} for r in enrich(base, spark.createDataFrame([("s", "S")], "id string, short_id string")).collect()}
    assert out["1"]["word_count"] == 40 and out["1"]["child_count"] == 1 and out["1"]["para_longest"] == 40 and out["1"]["t_g_meeting_minutes"] == 1 and out["1"]["date_reverse"] == 1
    assert abs(out["1"]["scaled"][0] - math.log1p(40) / math.log1p(1730.5)) < 1e-6
    assert set(out["2"][k] for k in SIGNAL_KEYS) == {0.0}
    rare = spark.createDataFrame([("word0", 9.0)], "word string, zipf double")
    one = enrich(base, spark.createDataFrame([("s", "S")], "id string, short_id string"), zipf=rare).where("id = '1'").head()
    assert abs(dict(zip(SIGNAL_KEYS, one.raw, strict=True))["lexic_jargon_share"] - 34 / 40) < 1e-6


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT iif(a > 1, 'like', \"b c\") FROM t -- like\nWHERE x LIKE 'a%' AND y GLOB 'a*[0-9]?'", "SELECT if(a > 1, 'like', `b c`) FROM t -- like\nWHERE x ILIKE 'a%' AND y RLIKE r'(?s)^a.*[0-9].$'"),
    ("select strftime('%Y-%m', ts), julianday(ts), total(x), json_group_array(y)", "select date_format(to_timestamp( ts), 'yyyy-MM'), (unix_timestamp(to_timestamp(ts)) / 86400.0D + 2440587.5D), coalesce(cast(sum(x) as double), 0.0D), to_json(collect_list(y))"),
    ("select group_concat(a, ', '), 'it''s glob', json_extract(j, '$.k') /* like */", "select listagg(a, ', '), 'it''s glob', get_json_object(j, '$.k') /* like */"),
])
def test_sql_translation(sql, want):
    from folioscope.plans.passthrough import translate

    assert translate(sql) == want


def test_sql_runs(spark):
    from folioscope.plans.passthrough import query

    rows = spark.createDataFrame([(1, "Abc", '{"k": 5}', "2024-01-02 03:04:05"), (2, "xbc", None, "2024-02-02 00:00:00")], "id int, s string, j string, ts string")
    out, kinds = query(spark, "select id, strftime('%Y/%m', ts) as m, json_extract(j, '$.k') as k, date(ts) as d, round(julianday(ts), 3) as jd from t where s like 'a%'", {"t": rows})
    assert [(r.id, r.m, r.k, str(r.d), r.jd) for r in out.collect()] == [(1, "2024/01", "5", "2024-01-02", 2460311.628)] and kinds[0] == ("id", "int")
    with pytest.raises(Exception, match="no_such"):
        query(spark, "select no_such from t")[0].collect()


def test_density_clusters_equal_plain_ones(spark):
    from folioscope.operators.explore import density_clusters

    r = random.Random(2)
    rows = []
    for i in range(90):
        angle = r.choice([0.2, 1.4]) + r.gauss(0, 0.05) if i < 80 else r.uniform(0, 6.28)
        rows.append((i, [math.cos(angle) * (1 + i % 3), math.sin(angle) * (1 + i % 3)]))
    rows += [(90 + k, rows[0][1]) for k in range(4)] + [(99, [0.0, 0.0])]
    unit = {i: np.array(v) / (math.hypot(*v) or 1) for i, v in rows}
    radius, least, near = 0.06, 12, 8
    close = {i: [j for j in unit if j != i and math.dist(unit[i], unit[j]) <= radius] for i in unit}
    core = {i for i in unit if len(close[i]) >= near}
    group = {i: i for i in core}
    for _ in range(len(core)):
        for i in core:
            for j in close[i]:
                if j in core:
                    group[i] = group[j] = min(group[i], group[j])
    for i in set(unit) - core:
        reach = sorted((math.dist(unit[i], unit[j]), j) for j in close[i] if j in core)
        if reach:
            group[i] = group[reach[0][1]]
    size = {g: sum(x == g for x in group.values()) for g in group.values()}
    got = {x.id: x.cluster for x in density_clusters(spark.createDataFrame(rows, "id long, vec array<double>"), radius, least, near).collect()}
    assert got == {i: group[i] if i in group and size[group[i]] >= least else -1 for i in unit} and len(set(got.values())) >= 3


def test_duplicates_in_tiles_equal_row_by_row(spark, monkeypatch):
    """One text with many vectors, and texts that are alike with many each: tiles of few rows give what rows give."""
    from folioscope.operators import duplicates as D

    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(words)
        if i % 3 == 1:
            t[59] = "other"
        rows.append((str(i), " ".join(t) if i % 3 != 2 else f"different text {i} " * 10, 60, [r.choice([0.0, 2.0, 4.0]) + r.random() * 0.8, r.random()]))
    pages = spark.createDataFrame([x[:3] for x in rows], "id string, plain_text string, word_count int")
    vectors = spark.createDataFrame([(x[0], x[3]) for x in rows], "id string, vec array<double>")
    plain = {x.id: x.group_id for x in D.scan_duplicates(pages, vectors).collect()}
    monkeypatch.setattr(D, "FEW_VECTORS", 1)
    monkeypatch.setattr(D, "MOST_ROWS", 16)
    tiled = {x.id: x.group_id for x in D.scan_duplicates(pages, vectors).collect()}
    assert tiled == plain and len(set(plain.values())) >= 2
    members = D.group_members(D.scan_duplicates(pages, vectors)).collect()
    assert sorted(i for g in members for i in g.members) == sorted(plain) and all(min(g.members) == g.group_id for g in members)


def test_radius_pairs_over_many_pivots(spark, monkeypatch):
    from folioscope.operators import duplicates as D

    monkeypatch.setattr(D, "LEAST_ROWS", 8)
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 5, 1))]).round(1)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(500, None)]
    got = {(x.a, x.b): x.distance for x in D.radius_pairs(spark.createDataFrame(rows, "id long, vec array<double>"), 0.5).collect()}
    first = {}
    for i, p in enumerate(points):
        first.setdefault(tuple(p), i)
    ids = sorted(first.values())
    want = {(i, j): math.dist(points[i], points[j]) for i in ids for j in ids if i < j and math.sqrt(sum((x - y) ** 2 for x, y in zip(points[i].tolist(), points[j].tolist(), strict=True))) <= 0.5}
    assert got == pytest.approx(want) and len(want) > 50
    assert D.radius_pairs(spark.createDataFrame([], "id long, vec array<double>"), 0.5).count() == 0


def test_merge_stream(spark, tmp_path):
    from folioscope.streaming.ingest import merge_stream

    schema = "id string, version int, title string"
    spark.createDataFrame([("1", 1, "old"), ("2", 1, "stays")], schema).write.parquet(str(tmp_path / "t0"))
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("1", 2, "new"), ("1", 3, "newest"), ("3", 1, "more")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = []

    def write(rows, number):
        rows.write.parquet(str(tmp_path / f"t{number + 1}"))
        done.append(number)

    stream = merge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda s: s.read.parquet(str(tmp_path / "t0")), write, str(tmp_path / "ck"))
    stream.awaitTermination(60)
    assert done == [0] and sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t1")).collect()) == [("1", 3, "newest"), ("2", 1, "stays"), ("3", 1, "more")]


def test_presentation(spark):
    from folioscope.functions import present as P

    row = spark.range(1).select(
        P.cut(P.F.lit("abcdef"), 4).alias("a"), P.cut(P.F.lit("ab"), 4, True).alias("b"), P.duration(P.F.lit(3725.9)).alias("c"), P.change_text(P.F.lit(-0.25)).alias("d"), P.change_text(P.F.lit(0.0005)).alias("e"),
    ).head()
    assert tuple(row) == ("abc…", "ab  ", "1:02:05", "▼ 0.25", "=")
    assert P.snippet("a b c\n\nd", 3, 2) == "a b\nc\n---" and P.snippet(None) == ""


def _plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_texts_lie(spark):
    from folioscope.operators.lexical import word_counts, zipf_of

    texts = spark.createDataFrame([(1, "the Cat the cat a-b 9x the"), (2, None), (3, "1 2"), (4, "cat")], "id long, text string")
    counts = word_counts(texts, ["a-b"])
    assert sorted(map(tuple, counts.collect())) == [(1, "cat", 2), (1, "the", 3), (1, "x", 1), (4, "cat", 1)] and "Exchange" not in _plan(counts)
    assert {r.word: round(10**r.zipf / 1e9 * 8) for r in zipf_of(texts).collect()} == {"the": 3, "cat": 3, "a-b": 1, "x": 1}


def test_field_profile_is_exact_without_a_field_in_one_task(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from folioscope.operators.stats import field_profile

    r = np.random.default_rng(3)
    fields = {"a": r.normal(size=1001), "b": r.integers(0, 2, 50).astype(float), "c": np.full(7, 3.0), "d": r.integers(-3, 9, 400) * 0.5, "e": np.array([1.5])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in fields.items() for x in v] + [("d", None)] * 5 + [("n", None)] * 2, "field string, value double")
    profile = field_profile(rows)
    assert "percentile" not in _plan(profile).lower()
    found = {x.field: x.asDict() for x in profile.collect()}
    for k, v in fields.items():
        f, total = found[k], len(v) + (5 if k == "d" else 0)
        assert np.allclose([f[c] for c in ("p25", "p50", "p75", "p95", "mean", "std")], [*np.percentile(v, [25, 50, 75, 95]), v.mean(), v.std()])
        assert f["zero_share"] == (v == 0).sum() / total and f["n_distinct"] == len(set(v)) and (f["min"], f["max"]) == (v.min(), v.max())
    assert found["n"]["n_distinct"] == 0 and found["n"]["p50"] is None


def test_keywords_lower_a_text_once(spark):
    from pyspark.sql import functions as F

    from folioscope.functions.text import keyword_hits

    rows = spark.createDataFrame([("A Release of THE release Notes",), (None,), ("",)], "t string").select(keyword_hits(F.col("t"), ["release", "notes", "hotfix", "the"]).alias("n"))
    assert [r.n for r in rows.collect()] == [3, 0, 0]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
