"""Divergence of sources, language identification and centroid clusters against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORDS = {"en": "the river and Stone of light over Été MIT".split(), "de": "der Fluß und STEIN die Straße über nacht".split(), None: "x yy Zz".split()}


def _texts():
    r, rows = random.Random(8), []
    for i in range(160):
        lang = r.choice(["en", "en", "de", None])
        own = WORDS[lang] + [f"w{chr(97 + j)}" for j in range(r.randint(0, 9))]
        rows.append((i, r.choice([" ", "-", "1", "\n"]).join(r.choice(own) for _ in range(r.randint(0, 40))), lang, r.choice(["a", "b", "c", "é", "", None])))
    rows += [(3, "the the river", "en", "a"), (None, "und der Fluß", "de", "b"), (None, None, None, None), (900, None, "en", "a"), (901, "123 ... ###", "fr", "only"), (902, "the river " * 30_000, "en", "b"), (903, "", "de", "c"), (5, "x", "", "q")]
    return rows


ROWS = _texts()


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns are named like the operators' own."""
    kinds = "doc_id long, text string, lang string, source string, term string, n long, document string, held_out int, vec string, p0 int"
    return spark.createDataFrame([(*r, "t", 1, "d", 7, "v", 0) for r in ROWS], kinds).repartition(5)


def _divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t, lang, source in rows]
    df, counts = Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {x[0] for x in docs}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        whole = Counter()
        for (x, _), c in counts.items():
            whole.update(c if x == lang else {})

        def shares(c):
            total = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept]

        q, p = shares(whole), {s: shares(c) for (x, s), c in counts.items() if x == lang}
        for s in p:
            pairs = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True))) for o in p if o != s]
            terms = [(t, a - b) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i) for i, (t, v) in enumerate(found[:last], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(1, 3), (6, 50), (10_000, 5)])
def test_divergence(odd, least, top):
    from folioscope.llm.divergence import source_divergence

    assert sorted(tuple(r) for r in source_divergence(odd, least=least, top=top).collect()) == _divergence(ROWS, least, top)


def test_divergence_of_nothing(odd):
    from folioscope.llm.divergence import source_divergence

    none = source_divergence(odd.where("doc_id < -1"))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_handed_on_early(monkeypatch):
    """However often a task hands on what it has combined, and wherever batches end, runs add up to the same."""
    import pyarrow as pa

    from folioscope.llm import divergence as D

    rows = [(lang or "", source or "", i, text or "") for i, (_, text, lang, source) in enumerate(ROWS)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k].encode() for r in rows], pa.binary()) if k != 2 else pa.array([r[2] for r in rows], pa.int64()) for k in range(4)], ["lang", "source", "document", "text"])

    def runs(size):
        counted = pa.Table.from_batches(list(D._count(iter([batch]))))
        counted = counted.take(pa.array(sorted(range(counted.num_rows), key=lambda i: tuple(counted[c][i].as_py() for c in ("term", "lang", "source", "document")))))
        return sorted(map(str, pa.Table.from_batches(list(D._frequent(4)(iter(counted.to_batches(max_chunksize=size))))).to_pylist()))

    whole = runs(100_000)
    for chunk in (50, 7, 3000):
        monkeypatch.setattr(D, "CHUNK", chunk)
        assert runs(3) == whole


def _cost(kept, after, seen, total, limit):
    bits = lambda a, b: round(math.log2(b / a) * 65536) if a else 0

    def cost(s):
        if not s:
            return 8 * 65536
        c = s[:-1]
        t, d = seen[c], len(after[c])
        if s in kept:
            return bits(kept[s], t + d)
        return (bits(t - sum(after[c]) + d, t + d) if t * limit >= total else 0) + cost(s[1:])

    return cost


def _ppm(train, order, strings, cells):
    """Costs by plain recursion over counts: lang -> (bytes before, byte) -> 2^-16 bits."""
    langs = sorted({x for x, _ in train})
    limit = max(1, min(strings, cells // (len(langs) ** 2 * (order + 1))))
    found = {}
    for lang in langs:
        whole = Counter()
        for x, text in train:
            if x == lang:
                data = bytes(order) + text
                whole.update(data[i - order : i + 1] for i in range(order, len(data)))
        total = sum(whole.values())
        if not total:
            continue
        n, seen = Counter(), Counter()
        for s, k in whole.items():
            for length in range(1, order + 2):
                n[s[order + 1 - length :]] += k
            for length in range(order + 1):
                seen[s[order - length : order]] += k
        kept = {s: k for s, k in n.items() if k * limit >= total}
        after = defaultdict(list)
        for s, k in kept.items():
            after[s[:-1]].append(k)
        found[lang] = _cost(kept, after, seen, total, limit)
    return found


@pytest.mark.parametrize(("order", "strings", "cells"), [(0, 1000, 1 << 20), (2, 1000, 1 << 20), (3, 40, 1 << 20), (4, 1000, 400)])
def test_language_id(odd, order, strings, cells, monkeypatch):
    from folioscope.llm import language_id as L

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    costs = _ppm([(x, t.encode()) for i, t, x, _ in ROWS if t is not None and x is not None and not held(i)], order, strings, cells)
    want = []
    for i, t, _, _ in ROWS:
        data = bytes(order) + (t or "").encode()
        if t is not None and len(t) > 10_000:
            data = data[: order + 5]  # its period is shown below
        bits = {x: sum(c(data[k - order : k + 1]) for k in range(order, len(data))) for x, c in sorted(costs.items())}
        best = min(bits, key=lambda x: (bits[x], x))
        letters = t is not None and any(map(str.isalpha, t))
        want.append((i, held(i), best if letters else "und", round(1 / sum(2.0 ** -min((b - bits[best]) / 65536, 1000) for b in bits.values()), 6) if letters else 0.0, round(bits[best] / 65536 / max(len((t or "").encode()), 1), 6)))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6), round(r.bits_per_byte, 6)) for r in L.identify(odd, order=order, strings=strings, cells=cells).collect()]
    short = lambda rows: sorted((r for r in rows if r[0] != 902), key=str)
    assert short(got) == short(want)
    assert [r[2] for r in got if r[0] == 902] == ["en"] or order == 0 or cells == 400
    monkeypatch.setattr(L, "CHUNK", 1000)  # in the closures; a long text then comes in many chunks
    again = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6), round(r.bits_per_byte, 6)) for r in L.identify(odd, order=order, strings=strings, cells=cells).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


def test_chunks_of_a_long_text(monkeypatch):
    import pyarrow as pa

    from folioscope.llm import language_id as L
    from folioscope.llm import textops as T

    texts = ["ab", "", "c" + "déf" * 50, "x", "yz" * 40]
    monkeypatch.setattr(L, "CHUNK", 7)
    for limit in (1, 30, 10_000):
        got = []
        for part in T.slices(pa.array(texts), limit):
            for strings, document in L._chunks(part, 3):
                got += [(part.first + int(d), int(s)) for s, d in zip(strings, document, strict=True)]
        assert got == [(d, int.from_bytes((bytes(3) + t.encode())[k : k + 4], "big")) for d, t in enumerate(texts) for k in range(len(t.encode()))]


def test_language_id_without_languages(odd):
    from pyspark.sql import functions as F

    from folioscope.llm.language_id import identify

    assert identify(odd.where("doc_id < -1")).count() == 0
    assert {(r.lang_pred, r.score) for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def _k_means(rows, k, rounds, limit=1 << 26):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-limit, min(limit, math.floor(64 * float(np.float32(x))))) for x in v]))
    start = sorted(kept, key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]
    at = [v for _, v in start]
    for step in range(rounds + 1):
        gaps = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in at] for _, v in kept]
        near = [min(range(len(at)), key=lambda c: (g[c], c)) for g in gaps]
        if step < rounds:
            groups = defaultdict(list)
            for (_, v), c in zip(kept, near, strict=True):
                groups[c].append(v)
            at = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if groups[c] else at[c] for c in range(len(at))]
    inertia = Counter()
    for c, g in zip(near, gaps, strict=True):
        inertia[c] += g[c]
    largest = (1 << 63) - 1  # of a long
    return sorted(((i, c, g[c], min(inertia[c], largest), min(sum(inertia.values()), largest), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (i, _), c, g in zip(kept, near, gaps, strict=True)), key=str)


def _vectors(scale):
    r = random.Random(4)
    middles = [[r.gauss(0, scale) for _ in range(64)] for _ in range(9)]
    rows = [(i, [m + r.gauss(0, scale / 20) for m in r.choice(middles)]) for i in range(400)]
    rows += [(i, list(rows[7][1])) for i in range(400, 560)]  # many copies of one
    rows += [(i, [float(r.randint(-1, 1)) / 64 for _ in range(64)]) for i in range(560, 620)]  # ties
    rows += [(3, rows[9][1]), (None, rows[11][1]), (None, rows[12][1]), (700, None), (701, []), (702, [1.0] * 63), (703, [1.0] * 65), (704, [1.0] * 63 + [None]), (705, [1.0] * 63 + [float("nan")]), (706, [float("-inf")] + [1.0] * 63)]
    return rows


@pytest.mark.parametrize(("scale", "block"), [(1.0, 1 << 15), (1.0, 100), (1e5, 90), (1e30, 200)])
def test_centroid_clusters(spark, monkeypatch, scale, block):
    from folioscope.llm import centroids as C

    monkeypatch.setattr(C, "BLOCK", block)
    rows = _vectors(scale)
    frame = spark.createDataFrame([(*x, 1, "c", 2.0) for x in rows], "vec_id long, embedding array<float>, cluster int, id string, vec double").repartition(3)
    got = C.centroid_clusters(frame).drop("centroid").collect()
    assert sorted((tuple(r) for r in got), key=str) == _k_means(rows, 16, 3)


def test_few_vectors_or_none(spark):
    from folioscope.llm.centroids import centroid_clusters

    rows = [(i, [float(i % 2)] * 64) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in centroid_clusters(frame).drop("centroid").collect()), key=str) == _k_means(rows, 16, 3)
    none = centroid_clusters(frame.where("vec_id > 9"))
    assert none.count() == 0 and none.columns == centroid_clusters(frame).columns


def test_trees_prune_and_assign_exactly():
    """Any stretch of a tree's rows is a tree; whole nodes and leaves together give each row its nearest centroid."""
    from folioscope.llm.centroids import Trees, tree_order

    r = np.random.default_rng(2)
    middles = r.integers(-500, 500, (6, 8))
    x = np.concatenate([m + r.integers(-9, 9, (500, 8)) for m in middles]).astype(np.int32)
    order, leaf = tree_order(x)
    assert np.bincount(leaf).max() <= 32 and sorted(order) == list(range(len(x)))
    for a, b in ((0, len(x)), (17, 2000), (900, 901)):
        own, z = x[order][a:b], middles[[0, 1, 2, 3, 4, 5, 5]]
        trees = Trees(own, np.zeros(b - a, np.int64), leaf[a:b])
        near = ((own[:, None, :].astype(np.int64) - z) ** 2).sum(axis=2).argmin(axis=1)
        assert (trees.clusters(z) == near).all()
        counts, totals = trees.sums(z)
        assert (counts == np.bincount(near, minlength=7)).all() and (totals == [own[near == c].sum(axis=0) for c in range(7)]).all()
        assert len(trees.assign(z[:6])[1]) < 0.2 * len(own) + 33
