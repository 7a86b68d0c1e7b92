"""Depths, descendants and sums of subtrees against plain walks: deep chains, cycles with trees on them, several parents."""

import random
from collections import Counter

import pytest

from folioscope.operators import tree


def _below(edges, start):
    """Descendants of a node with their shortest distance."""
    children, seen, level, distance = {}, {}, [start], 0
    for p, c in edges:
        children.setdefault(p, set()).add(c)
    while level:
        distance += 1
        level = [c for c in {c for x in level for c in children.get(x, ())} if c not in seen and c != start]
        seen.update(dict.fromkeys(level, distance))
    return seen


def _frames(spark, edges, pages):
    return spark.createDataFrame(edges, "parent string, child string").repartition(3), spark.createDataFrame(pages, "id string, title string, word_count int, page_type string").repartition(3)


def _check(spark, edges, pages, starts):
    e, p = _frames(spark, edges, pages)
    about = {i: (w, t) for i, _, w, t in pages}
    want = {}
    for x in {x for pair in edges for x in pair} | set(about):
        found = [about[d] for d in _below(edges, x) if d in about]
        if found:
            words = [w for w, _ in found if w is not None]
            types = Counter(t for _, t in found if t is not None)
            want[x] = (len(found), float(round(sum(words) / len(words) / 10) * 10) if words else 0.0, min(types, key=lambda t: (-types[t], t)) if types else None)
    assert {r.id: (r.n_descendants, r.avg_words, r.common_type) for r in tree.subtree_metrics(p, e).collect()} == want
    for x, most in starts:
        got = {r.descendant: r.distance for r in tree.descendants(p, e, x, most).collect()}
        assert got == {d: n for d, n in _below(edges, x).items() if most is None or n <= most}
    roots = set(about) - {c for p, c in edges if p != c}
    depth = {}
    for root in roots:
        for x, n in {root: 0, **_below(edges, root)}.items():
            depth[x] = min(n, depth.get(x, n))
    assert {r.id: r.depth for r in tree.depths(p, e).collect()} == {x: depth.get(x, 0) for x in about}


def _pages(ids, seed=3):
    r = random.Random(seed)
    return [(i, f"t{i}", r.choice([None, 0, 12, 250, 900]), r.choice([None, "a", "b", "c"])) for i in ids]


@pytest.mark.parametrize("kind", ["forest", "cycles", "several"])
def test_random_trees(spark, kind):
    r = random.Random(5)
    edges = [(str(r.randrange(max(0, i - 9), i)), str(i)) for i in range(1, 90) if i % 17] + [("ghost", "5x"), ("5x", "6x"), ("5", "5")]
    if kind == "cycles":
        edges += [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c1", "h1"), ("h1", "h2"), ("c0", "h3"), ("d1", "d2"), ("d2", "d1"), ("s", "s"), ("s", "t")] + [(f"l{i}", f"l{(i + 1) % 37}") for i in range(37)]
    if kind == "several":
        edges += [("3", "50"), ("c0", "c1"), ("c1", "c0"), ("c1", "50")]
    edges += edges[:4]
    ids = sorted({x for pair in edges for x in pair} - {"ghost", "7"}) + ["alone"]
    _check(spark, edges, _pages(ids), [("0", None), ("17", 2), ("c1", None), ("l3", None), ("l3", 20), ("nobody", None)])


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    edges = [(str(i), str(i + 1)) for i in range(n - 1)]
    e, p = _frames(spark, edges, [(str(i), f"t{i}", 100, "a") for i in range(n)])
    assert len(tree.lifted(tree.single_parents(e))[0]) == 15
    found = {r.id: r.n_descendants for r in tree.subtree_metrics(p, e).collect()}
    assert found == {str(i): n - 1 - i for i in range(n - 1)}
    assert {r.id: r.depth for r in tree.depths(p, e).collect()} == {str(i): i for i in range(n)}
    below = tree.descendants(p, e, "4000").collect()
    assert [(r.descendant, r.distance) for r in below] == [(str(4000 + i), i) for i in range(1, n - 4000)]
