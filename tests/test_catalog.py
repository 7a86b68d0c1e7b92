"""Catalog queries against their SQL on the smallest tables, and golden cases of the page functions."""

import os

import duckdb
import pytest

from folioscope.plans import catalog

DATA = "/root/testdata/sf0.001"
CHEAP = ["q_overview_space", "q_type_breakdown", "q_author_squash", "q_popular_links", "q_orphans", "q_cross_space", "q_merge_upsert", "q_date_in_title", "q_eval_notes", "q_snapshot_diff", "q_norm_author", "q_scores_gems", "q_label_merge", "q_vector_classes", "q_radius_pairs", "q_plain_text", "q_lead_paragraph", "q_fuzzy_labels"]


def _rows(rows):
    return sorted(tuple(str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = catalog.QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert _rows(got.collect()) == _rows(want)


def test_excerpts_round_trip(spark):
    from folioscope.operators.changes import add_excerpts, remove_excerpts

    pages = spark.createDataFrame([("1", "<p>a b</p>", 3, "S"), ("2", "<ac:layout><p>x</p></ac:layout>", 1, "S"), ("3", "none", 1, "S")], "id string, html string, version int, space_id string")
    added = add_excerpts(pages, pages.select("id"), "Source", "box", "T").cache()
    assert {r.id: (r.status, r.version) for r in added.collect()} == {"1": ("changed", 4), "2": ("changed", 2), "3": ("no-place", 1)}
    back = {r.id: r.html for r in remove_excerpts(added, added.select("id")).collect()}
    assert back == {r.id: r.html for r in pages.collect()}


def test_schema_contract():
    from folioscope.functions.signals import SIGNAL_KEYS
    from folioscope.schema import PAGE_COLUMNS

    assert len(PAGE_COLUMNS) == len(set(PAGE_COLUMNS)) == 38 and len(SIGNAL_KEYS) == len(set(SIGNAL_KEYS)) == 70


def test_depths_and_closure_end_on_cycles(spark):
    from folioscope.operators.tree import closure, depths

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "parent string, child string")
    nodes = spark.createDataFrame([(x,) for x in "abcxy"], "id string")
    assert {r.id: r.depth for r in depths(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 0}
    assert {(r.ancestor, r.descendant, r.distance) for r in closure(edges).collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("x", "y", 1), ("y", "x", 1)}


def test_scan_duplicates_equals_brute_force(spark):
    import math
    import random

    from folioscope.operators.duplicates import scan_duplicates
    from folioscope.schema import JACCARD, RADIUS, SHINGLE_WORDS

    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(80):
        words = base[i % 5].split()
        if i % 3 == 0:
            words[r.randrange(len(words))] = "zz"
        rows.append((str(i), " ".join(words), 60 if i % 11 else 5, [round(r.choice([0.0, 0.4, 0.9, 2.0]) + (0.01 * i if i % 4 == 0 else 0), 3) for _ in range(2)]))
    pages = spark.createDataFrame([x[:3] for x in rows], "id string, plain_text string, word_count int")
    vectors = spark.createDataFrame([(x[0], x[3]) for x in rows], "id string, vec array<double>")

    grams = {x[0]: {tuple(x[1].split()[k : k + SHINGLE_WORDS]) for k in range(len(x[1].split()) - SHINGLE_WORDS + 1)} for x in rows}
    full = [x for x in rows if x[2] >= 25]
    group = {int(x[0]): int(x[0]) for x in full}
    linked = set()
    for _ in range(8):
        for x in full:
            for y in full:
                if x[0] < y[0] and math.dist(x[3], y[3]) <= RADIUS and len(grams[x[0]] & grams[y[0]]) >= JACCARD * len(grams[x[0]] | grams[y[0]]):
                    a, b = int(x[0]), int(y[0])
                    group[a] = group[b] = min(group[a], group[b])
                    linked |= {a, b}
    got = {w.id: w.group_id for w in scan_duplicates(pages, vectors).collect()}
    assert got == {i: g for i, g in group.items() if i in linked} and len(set(got.values())) > 5


def test_jaccard_join_moves_prefixes_not_sets(spark, monkeypatch):
    import random

    from folioscope.operators import duplicates as D

    r = random.Random(5)
    usual = " ".join(f"u{i}" for i in range(30))
    texts = {}
    for i in range(120):
        words = texts[r.randrange(i)].split() if i and i % 2 else (usual + " " + " ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(0, 90)))).split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = f"z{i}"
        texts[i] = " ".join(words)
    texts |= {200: "", 201: "a b c", 202: texts[0], 203: texts[0].upper()}
    grams = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    first = {}
    for i in sorted(grams):
        first.setdefault(grams[i], i)
    ids = sorted(i for g, i in first.items() if g)
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    for frequent, sent in ((100_000, 500_000), (3, 0)):  # whatever is known to be frequent, and whether ids are sent or joined
        monkeypatch.setattr(D, "FREQUENT", frequent)
        monkeypatch.setattr(D, "MOST_SENT", sent)
        for least in (0.5, 0.8):
            want = {(a, b) for a in ids for b in ids if a < b and len(grams[a] & grams[b]) >= least * len(grams[a] | grams[b])}
            assert {(x.a, x.b) for x in D.jaccard_join(rows, least).collect()} == want and want
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 9])], "id long, s array<bigint>")
    assert sorted(map(tuple, D._prefixes(sets, 0.8, 2).collect())) == [(1, 5, 4), (1, 5, 5), (2, 4, 9)]  # rarest first; 5 - 4 + 1 and 4 - 4 + 1 of them


def test_near_copies_move_once_for_all_their_pairs(spark, monkeypatch):
    """Many near copies of one text: what pairs share is counted before it is moved, and sets are moved for tiles, whatever their bounds."""
    import random

    from folioscope.operators import duplicates as D

    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(70):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"z{i}"
        texts[i] = " ".join(words)
    texts |= {100 + i: " ".join(f"y{r.randint(0, 400)}" for _ in range(r.randint(5, 60))) + " " + " ".join(base[:20]) for i in range(40)}
    grams = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in texts.items())}
    first = {}
    for i in sorted(grams):
        first.setdefault(grams[i], i)
    ids = sorted(first.values())
    alike = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in ids for b in ids if a < b}
    for kind, bounds in (("long", (2048, 1 << 21, 1 << 17)), ("string", (4, 300, 50))):
        rows = spark.createDataFrame([(i if kind == "long" else f"{i:04}", t) for i, t in texts.items()], f"id {kind}, text string")
        for name, value in zip(("TILE_TEXTS", "TILE_SHINGLES", "TASK_ROWS"), bounds):
            monkeypatch.setattr(D, name, value)
        got = [(int(x.a), int(x.b), x.similarity) for x in D.jaccard_join(rows, 0.8).collect()]
        assert sorted(got) == sorted((a, b, s) for (a, b), s in alike.items() if s >= 0.8) and len(got) > 50
    sets = rows.select("id", D.F.array_sort(D.F.transform(D.shingles(D.F.col("text")), lambda s: D.F.xxhash64(s))).alias("s"))
    keys = D._prefixes(sets, 0.8, len(texts), places=True)
    held = D._candidates(keys, 0.8).count()  # of pairs that share a shingle of their prefixes, few that aren't alike
    shared = keys.select(D.F.col("id").alias("a"), "x").join(keys.select(D.F.col("id").alias("b"), "x"), "x").where("a < b").select("a", "b").distinct().count()
    assert held < shared
    # bounds that rounding would raise: 0.56 * 25 is more than 14
    rounded = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(18))), (2, " ".join(f"q{i}" for i in range(29)))], "id long, text string")
    assert [(x.a, x.b, x.similarity) for x in D.jaccard_join(rounded, 0.56).collect()] == [(1, 2, 0.56)]


def test_groups_of_many_near_copies_in_small_tiles(spark, monkeypatch):
    """Groups are the same whether near copies meet in one tile or in many."""
    from folioscope.operators import duplicates as D

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:40] + [f"t{i // 20}-{k}" for k in range(20)][: 20 - i % 20 % 2] + ["end"] * (i % 3)) for i in range(60)]
    pages = spark.createDataFrame([(str(i), t, 60) for i, t in enumerate(texts)], "id string, plain_text string, word_count int")
    vectors = spark.createDataFrame([(str(i), [float(i // 20)]) for i in range(60)], "id string, vec array<double>")
    found = []
    for bounds in ((2048, 1 << 21, 1 << 17), (2, 100, 20)):
        for name, value in zip(("TILE_TEXTS", "TILE_SHINGLES", "TASK_ROWS"), bounds):
            monkeypatch.setattr(D, name, value)
        found.append({x.id: x.group_id for x in D.scan_duplicates(pages, vectors).collect()})
    assert found[0] == found[1] == {i: i // 20 * 20 for i in range(60)}
