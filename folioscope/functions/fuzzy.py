"""Fuzzy similarity of short names, and complete-linkage clusters of a vocabulary."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialise

#: Names of a block of the vocabulary; two blocks meet in a task.
BLOCK_NAMES = 256


@lru_cache(maxsize=1 << 14)
def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in one whole number."""
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity, 0 to 100."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best of the shorter one against windows of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n, best = len(a), 0.0
    for i in range(1 - n, len(b)):
        window = b[max(0, i) : min(len(b), i + n)]
        if 200.0 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(a, window))
    return best


def _token_ratios(a: str, b: str, f) -> float:
    s, t = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
    ordered = f(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if not s or not t:
        return ordered
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ordered, f(one, two)]
    if both:
        found += [f(both, one), f(both, two)]
    return max(found)


def _scale(a: str, b: str) -> float:
    """What a part counts by the lengths of two names; 1 if they are about as long, when parts don't count."""
    n = max(len(a), len(b)) / min(len(a), len(b))
    return 1.0 if n < 1.5 else 0.9 if n <= 8 else 0.6


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    scale = _scale(a, b)
    if scale == 1.0:
        return max(ratio(a, b), 0.95 * _token_ratios(a, b, ratio))
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * _token_ratios(a, b, partial_ratio))


@lru_cache(maxsize=1 << 14)
def _letters(a: str) -> tuple[dict[str, int], int, int, int]:
    """How often each letter occurs but for blanks, how many there are, and the fewest and the most blanks of any way in which the tokens are joined."""
    counts: dict[str, int] = {}
    for c in a:
        if not c.isspace():
            counts[c] = counts.get(c, 0) + 1
    n, tokens = sum(counts.values()), len(a.split())
    return counts, n, min(max(tokens - 1, 0), len(a) - n), max(tokens - 1, len(a) - n)


def _most(a: str, b: str, scale: float) -> float:
    """What any order of the tokens of two names scores at most: no common subsequence is longer than their common letters."""
    (x, n, p, q), (y, m, r, s) = _letters(a), _letters(b)
    common = sum(min(k, y.get(c, 0)) for c, k in x.items()) + min(q, s)
    most = 200.0 * common / max(n + p + m + r, 1)
    if scale != 1.0:  # a window may be as short as what is common
        short = min(n + p, m + r)
        most = max(most, scale * 200.0 * common / max(short + min(common, short), 1))
    return most


def can_reach(a: str, b: str, least: float) -> bool:
    """False only if ``weighted_ratio`` is below ``least``; cheap, from letters in common.

    A name is compared as it is and as the set of its tokens, which is shorter where tokens repeat.
    """
    if not a or not b:
        return least <= 0
    one, two = dict.fromkeys(a.split()), dict.fromkeys(b.split())
    if not one.keys().isdisjoint(two):
        return True
    scale = _scale(a, b)
    return _most(a, b, scale) >= least or _most(" ".join(one), " ".join(two), scale) >= least


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_similarity, "double")(a, b)


def nearest_labels(labels: DataFrame, name: str, least: float = 75, top: int = 3) -> DataFrame:
    """``label, score`` of the labels most like ``name`` but for itself, the most alike first."""

    def score(names: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(x, name) if can_reach(x, name, least) else 0.0 for x in names], dtype="float64")

    scored = labels.select("label").where(F.col("label").isNotNull() & (F.col("label") != name)).distinct().withColumn("score", F.pandas_udf(score, "double")("label"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "label").limit(top)


def complete_linkage(distance: np.ndarray, most: float) -> np.ndarray:
    """Cluster numbers: closest clusters first, by their farthest members, up to ``most``."""
    d, label = distance.astype(float).copy(), np.arange(len(distance))
    np.fill_diagonal(d, np.inf)
    while len(d) > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > most:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        label[label == j] = i
    return label


def similar_pairs(names: DataFrame, least: float) -> DataFrame:
    """``a, b, score`` (a < b) of the rows of ``names(id, label)`` at least that alike; ids are whole numbers.

    Blocks of ``BLOCK_NAMES`` names meet in tasks of their own, and pairs with too few letters in common are
    not compared.
    """
    blocks = max(1, -(-names.count() // BLOCK_NAMES))
    own = names.select("id", "label", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), (F.col("own") > F.col("other")).alias("side"), "id", "label")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["id"].tolist(), pdf["label"].tolist(), pdf["side"].tolist(), strict=True))
        within = pdf["t1"].iloc[0] == pdf["t2"].iloc[0]
        left, right = (rows, rows) if within else ([r for r in rows if not r[2]], [r for r in rows if r[2]])
        out = []
        for i, a, _ in left:
            for j, b, _ in right:
                if (i < j or not within) and can_reach(a, b, least):
                    s = weighted_ratio(a, b)
                    if s >= least:
                        out.append((min(i, j), max(i, j), s))
        return pd.DataFrame(out, columns=["a", "b", "score"]).astype({"a": "int64", "b": "int64", "score": "float64"})

    return sent.groupBy("t1", "t2").applyInPandas(compare, "a long, b long, score double")


def redundant_labels(counts: DataFrame, least: float = 75) -> DataFrame:
    """``labels, total`` for clusters of near-equal labels, the largest total first, from rows ``label, pages``.

    Only names that are alike can be in one cluster, so each component of alike names is clustered alone, with
    the same result as the whole vocabulary at once; a component is one task.
    """
    names = materialise(counts.where(F.col("label").isNotNull()).select(F.monotonically_increasing_id().alias("id"), "label", F.col("pages").cast("long").alias("pages")), "labels")
    pairs = materialise(similar_pairs(names, least), "alike")
    parts = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    parts = materialise(parts, "parts")
    members = names.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id")
    edges = pairs.join(parts.select(F.col("node").alias("a"), F.col("component").alias("link_part")), "a")

    def cluster(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "label"], ascending=[False, True]).reset_index(drop=True)
        place = {i: k for k, i in enumerate(rows["id"].tolist())}
        d = np.full((len(rows), len(rows)), 101.0)
        for a, b, s in zip(found["a"].tolist(), found["b"].tolist(), found["score"].tolist(), strict=True):
            d[place[a], place[b]] = d[place[b], place[a]] = 100 - s
        rows["cluster"] = complete_linkage(d, 100 - least)
        groups = [g for _, g in rows.groupby("cluster", sort=False) if len(g) > 1]
        out = pd.DataFrame({"labels": pd.Series([g["label"].tolist() for g in groups], dtype=object)})
        return out.assign(total=pd.Series([int(g["pages"].sum()) for g in groups], dtype="int64"))

    out = members.groupBy("part").cogroup(edges.groupBy("link_part")).applyInPandas(cluster, "labels array<string>, total long")
    return out.orderBy(F.desc("total"), F.col("labels")[0])
