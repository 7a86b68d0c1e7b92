"""SimHash near-dedup by a binary trie self-join.

A fingerprint's 64 bits are cut into ``ERRORS + 1`` blocks; of two fingerprints within ``ERRORS`` bits at
least one block is equal.  For each block there is a trie whose top levels are that block's bits: there
the budget is zero, so a node meets only itself, and its subtree is one unit of work dealt out by
(block, value).  Below, pairs of nodes go down together, the differing bits add up and a pair is dropped
once they exceed the budget.  Pairs whose subtrees are already one component are not descended, and a unit
returns each member with its component's smallest id, so a dense group costs rows in proportion to its
members and not to its pairs.  A unit above ``UNIT_ROWS`` is cut into chunks that meet pair by pair.

Links are between fingerprints, so a row's id plays no part in them; a component is named afterwards by the
smallest id among its rows.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal fingerprints
are one class; rows that repeat an id with different texts are judged each by its own text; a component is
null only if all its rows have null ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from ..operators.components import connected_components
from ..operators.skew import join_groups
from ..storage import materialise, shuffle_partitions

BITS, ERRORS, SHINGLE, SEED = 64, 4, 4, 42
UNIT_ROWS = 50_000
BUCKET_ROWS = 200_000
_PAIRS = 1 << 19
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 14)], ends[i : i + (1 << 14)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = T.string_column(batch.column(1)).cast(pa.large_binary())
        prints = np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "print"])


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        out = np.array(self.parent)
        while True:
            up = out[out]
            if (up == out).all():
                return out
            out = up


def trie_join(keys: np.ndarray, roots: list[np.ndarray], budget: int = ERRORS) -> np.ndarray:
    """Labels of the components of ``keys`` (uint64, ascending within each root range).

    ``roots`` are arrays (u_lo, u_hi, v_lo, v_hi): the node pairs to start from.  A node is a range of
    ``keys`` that agree on all bits above the current level.
    """
    union = _Union(len(keys))
    u_lo, u_hi, v_lo, v_hi = roots
    own = (u_lo == v_lo) & (u_hi - u_lo > 1)
    starts, n = u_lo[own], (u_hi - u_lo)[own] - 1
    near = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    near = near[np.bitwise_count(keys[near] ^ keys[near + 1]) <= budget]
    union.join(near, near + 1)
    labels = union.labels()
    changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
    ones: dict[int, np.ndarray] = {}
    stack = [(BITS - 1, u_lo, u_hi, v_lo, v_hi, np.zeros(len(u_lo), np.int64))]
    while stack:
        bit, u_lo, u_hi, v_lo, v_hi, errors = stack.pop()
        if len(u_lo) > _PAIRS:
            half = len(u_lo) // 2
            stack += [(bit, *(x[:half] for x in (u_lo, u_hi, v_lo, v_hi, errors))), (bit, *(x[half:] for x in (u_lo, u_hi, v_lo, v_hi, errors)))]
            continue
        one = (changes[u_hi - 1] == changes[u_lo]) & (changes[v_hi - 1] == changes[v_lo]) & (labels[u_lo] == labels[v_lo])
        leaf = (u_hi - u_lo == 1) & (v_hi - v_lo == 1)
        ended = leaf & ~one
        if ended.any():
            a, b = u_lo[ended], v_lo[ended]
            hit = np.bitwise_count(keys[a] ^ keys[b]) <= budget
            if hit.any():
                union.join(a[hit], b[hit])
                labels = union.labels()
                changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        down = ~one & ~leaf
        if not down.any() or bit < 0:
            continue
        u_lo, u_hi, v_lo, v_hi, errors = (x[down] for x in (u_lo, u_hi, v_lo, v_hi, errors))
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum(keys >> np.uint64(bit) & np.uint64(1))]).astype(np.int64)
        seen = ones[bit]
        u_mid, v_mid = u_hi - (seen[u_hi] - seen[u_lo]), v_hi - (seen[v_hi] - seen[v_lo])
        own = u_lo == v_lo
        apart, cross = errors < budget, ~own
        kinds = [(u_lo, u_mid, v_lo, v_mid, errors, None), (u_mid, u_hi, v_mid, v_hi, errors, None), (u_lo, u_mid, v_mid, v_hi, errors + 1, apart), (u_mid, u_hi, v_lo, v_mid, errors + 1, apart & cross)]
        parts = []
        for a, b, c, d, e, allowed in kinds:
            ok = (b > a) & (d > c) & ~((a == c) & (b - a == 1))
            if allowed is not None:
                ok &= allowed
            parts.append([x[ok] for x in (a, b, c, d, e)])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return labels


def _blocks(n: int = ERRORS + 1) -> list[tuple[int, int]]:
    """Lowest bit and width of each block."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bucket(table: pa.Table) -> pa.Table:
    """All units of a bucket together: each member that has a partner, with its component's smallest member."""
    block, key, tile, side, prints = (table.column(i).to_numpy() for i in range(1, 6))
    ids = prints
    low = np.array([x[0] for x in _blocks()], np.uint64)[block]
    prints = prints.view(np.uint64)
    turned = (prints >> low) | (prints << ((np.uint64(BITS) - low) & np.uint64(63)))  # the block's bits come last
    width = np.array([x[1] for x in _blocks()], np.uint64)[block]
    turned = (turned << (np.uint64(BITS) - width)) | (turned >> width)  # and now first
    order = np.lexsort((turned, side, tile, key, block))
    block, key, tile, side, turned, ids = (x[order] for x in (block, key, tile, side, turned, ids))
    fresh = np.ones(len(ids) + 1, bool)
    fresh[1:-1] = (block[1:] != block[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
    lo = np.flatnonzero(fresh)[:-1]
    hi = np.flatnonzero(fresh)[1:]
    mid = hi - np.add.reduceat(side, lo) if len(lo) else hi
    own = mid == hi
    crossed = ~own & (mid > lo)
    roots = [np.concatenate([lo[own], lo[crossed]]), np.concatenate([hi[own], mid[crossed]]), np.concatenate([lo[own], mid[crossed]]), np.concatenate([hi[own], hi[crossed]])]
    labels = trie_join(turned, roots)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, ids)
    least = least[labels]
    linked = least != ids
    return pa.table({"u": pa.array(ids[linked], pa.int64()), "v": pa.array(least[linked], pa.int64())})


def links(classes: DataFrame) -> DataFrame:
    """Edges ``u, v`` that connect what is within ``ERRORS`` bits, from one row ``print`` per class."""
    spark = classes.sparkSession
    whole = lambda low, width: F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    each = F.array(*(F.struct(F.lit(i).alias("block"), whole(low, width).alias("key")) for i, (low, width) in enumerate(_blocks())))
    units = classes.select("print", F.explode(each).alias("x")).select("x.block", "x.key", "print")
    large = units.groupBy("block", "key").count().where(F.col("count") > UNIT_ROWS)
    if large.head(1):
        chunks = large.select("block", "key", F.ceil(F.col("count") / UNIT_ROWS).cast("int").alias("chunks"))
        chunk = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
        units = units.join(chunks, ["block", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
        units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        units = units.withColumn("tile", F.least("chunk", "other") * 65536 + F.greatest("chunk", "other")).withColumn("side", (F.col("chunk") > F.col("other")).cast("int"))
    else:
        units = units.withColumn("tile", F.lit(0)).withColumn("side", F.lit(0))
    n = units.count()
    buckets = max(shuffle_partitions(spark), -(-n // BUCKET_ROWS))
    bucket = F.pmod(F.hash("block", "key", "tile"), F.lit(buckets))
    return units.select(bucket.alias("bucket"), "block", "key", "tile", "side", "print").groupBy("bucket").applyInArrow(_bucket, "u long, v long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Fingerprints are made once and kept in the shared folder.  Documents become one class per fingerprint
    before anything is joined, so copies cost one row each; large classes and components are broadcast.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = materialise(named.mapInArrow(_fingerprints, "id long, print long"), "prints")
    classes = materialise(prints.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    linked = connected_components(links(classes)).select(F.col("node").alias("print"), "component")
    placed = materialise(classes.join(linked, "print", "left").select("print", "id", "n", F.coalesce("component", "print").alias("component")), "placed")
    named = materialise(placed.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("classes")), "components")
    count, rows = named.agg(F.sum("classes")).head()[0] or 0, placed.agg(F.sum("n")).head()[0] or 0
    found = materialise(join_groups(placed.select("print", "n", "component"), named, "component", "classes", count).select("print", "n", "component_id"), "named")
    out = join_groups(prints, found, "print", "n", rows)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
