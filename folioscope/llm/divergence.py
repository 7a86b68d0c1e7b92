"""Source divergence audit: how unlike the sources of a language use its terms, by a sort-based stream.

The terms of each document are counted where it is read and combined per (lang, term, source) over the documents of a
task, up to a bounded size of text.  These rows are repartitioned by (lang, term) and sorted within partitions by term,
lang, source and first document; a scan adds up runs in one pass, holding the rows of one term, one per source, at a
time.  A run yields the term's document frequency, which decides whether its language keeps it, and its counts, which
are written once.  A hot term has a row for each task and source, not for each document.

With the totals that follow from them every occurrence of a term in a group gets its p, and a second sorted scan emits
partial pairs per run.  For groups g and h of a language, with p0 for a count of 0,

    sum |pg - ph| over all V kept terms = V |p0g - p0h| + B(g, p0h) + B(h, p0g) + A(g, h)

where B(g, x) is the sum of |pg - x| - |p0g - x| over the terms that g has, and A the sum of |pg - ph| - |pg - p0h| -
|p0g - ph| + |p0g - p0h| over those that both have.  Only A needs the terms of two groups together, so absent terms cost
nothing; B is read off running sums over the distinct values of p, merged with the x of all other groups.  Terms above
the language's average come from a rank over the same rows.  Nothing is collected; totals are joined, not broadcast.

Defined results: null texts, languages and sources count as empty strings; a row is a document, also where ids repeat;
rows without terms still give their group, with value 0 for each pair if nothing is kept; a language with one source has
no pairs; bytes that are not UTF-8 count as letters; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise

_BYTES = np.arange(256, dtype=np.uint8)
_IS_TERM = (_BYTES >= 128) | ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES | 32, _BYTES).astype(np.uint8)
UNIT, PRIOR = 1_000_000_000, 5
#: Bytes of text whose terms are combined at once, pairs that a scan makes at once, and pairs that it holds.
CHUNK, PAIRS, HELD = 10 << 20, 1 << 21, 400_000
_RUN = "lang binary, term binary, source binary, document long, n_docs long, n long"


def _terms(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of texts that stand one after another in ``data``, and each term's number and text."""
    inside = _IS_TERM[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[ends[ends < len(data)]] = False  # a text ends a term
    starts = np.flatnonzero(inside & ~before)
    sums = np.concatenate([[0], np.cumsum(inside)])
    packed = _LOWER[data[inside]]
    offsets = np.append(sums[starts], len(packed)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return terms.dictionary, terms.indices.to_numpy(), np.searchsorted(ends, starts, "right")


def _long_text(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms of one text and how often each occurs, cut into parts where no term is."""
    parts, a = [], 0
    gaps = np.flatnonzero(~_IS_TERM[data])
    while a < len(data):
        i = np.searchsorted(gaps, a + CHUNK)
        b = int(gaps[i]) + 1 if i < len(gaps) else len(data)
        terms, code, _ = _terms(data[a:b], np.array([b - a]))
        parts.append(pa.table({"term": terms, "n": np.bincount(code, minlength=len(terms))}))
        a = b
    found = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
    return found["term"].combine_chunks(), found["n_sum"].to_numpy()


def _chunk(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """``lang, term, source, document, n_docs, n`` of texts, combined over documents; ``document`` is the first with the term."""
    groups: dict[tuple[bytes, bytes], int] = {}
    group = np.array([groups.setdefault(r[:2], len(groups)) for r in rows], np.int64)
    if len(rows) == 1 and len(rows[0][3]) > CHUNK:
        terms, n = _long_text(rows[0][3])
        code, own, first, docs = np.arange(len(terms)), np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64), np.ones(len(terms), np.int64)
    else:
        terms, code, text = _terms(np.concatenate([r[3] for r in rows]), np.cumsum([len(r[3]) for r in rows]))
        pairs, n = np.unique(text.astype(np.int64) << 32 | code, return_counts=True)
        text, code = pairs >> 32, pairs & 0xFFFFFFFF
        keys, first, where, docs = np.unique(group[text] << 32 | code, return_index=True, return_inverse=True, return_counts=True)
        n = np.bincount(where, n, len(keys)).astype(np.int64)  # exact below 2^53
        own, code, first = keys >> 32, keys & 0xFFFFFFFF, text[first]
    langs, sources = (pa.array([g[i] for g in groups], pa.binary()) for i in range(2))
    documents = np.array([r[2] for r in rows], np.int64)
    for a in range(0, len(code), 50_000):
        at = slice(a, a + 50_000)
        columns = [langs.take(pa.array(own[at])), terms.take(pa.array(code[at])), sources.take(pa.array(own[at])), *(pa.array(x.astype(np.int64)) for x in (documents[first[at]], docs[at], n[at]))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "document", "n_docs", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for lang, source, document, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "document")), batch["text"], strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
            if held and size + len(data) > CHUNK:
                yield from _chunk(held)
                held, size = [], 0
            held.append((lang, source, document, data))
            size += len(data)
    if held:
        yield from _chunk(held)


def _changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first always does."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        column = table[name].combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).to_numpy(zero_copy_only=False)
    return new


def _whole_terms(batches: Iterator[pa.RecordBatch], combine) -> Iterator[pa.Table]:
    """Sorted rows as tables that no (lang, term) spans; ``combine`` shortens the rows of a term that go on."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = int(np.flatnonzero(_changes(table, ["lang", "term"]))[-1])
        if last:
            yield table.slice(0, last)
        held = combine(table.slice(last))
    if held is not None:
        yield held


def _runs(table: pa.Table) -> pa.Table:
    """One row per (lang, term, source) of sorted rows."""
    starts = np.flatnonzero(_changes(table, ["lang", "term", "source"]))
    out = table.take(pa.array(starts))
    for name in ("n_docs", "n"):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(np.add.reduceat(table[name].to_numpy(), starts)))
    return out


def _frequent(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_terms(batches, _runs):
            runs = _runs(table)
            head = _changes(runs, ["lang", "term"])
            starts = np.flatnonzero(head)
            sizes = np.diff(np.append(starts, runs.num_rows))
            df, total = (np.add.reduceat(runs[c].to_numpy(), starts) for c in ("n_docs", "n"))
            kept = np.repeat(df >= least, sizes)
            out = runs.select(["lang", "term", "source", "n"]).append_column("total", pa.array(np.repeat(total, sizes))).append_column("head", pa.array(head.astype(np.int64)))
            yield from out.filter(pa.array(kept)).to_batches()

    return scan


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A(g, h) of the terms of a partition, for each pair of sources that have one in common."""
    codes: dict[tuple[bytes, bytes], int] = {}
    held: dict[int, int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        names = list(codes)
        rows = [(names[k >> 32][0], names[k >> 32][1], names[k & 0xFFFFFFFF][1], v) for k, v in held.items()]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["lang", "source", "item", "value"])
        held.clear()

    for table in _whole_terms(batches, lambda t: t):
        starts = np.flatnonzero(_changes(table, ["lang", "term"]))
        ends = np.append(starts[1:], table.num_rows)
        own = np.array([codes.setdefault(x, len(codes)) for x in zip(table["lang"].to_pylist(), table["source"].to_pylist(), strict=True)], np.int64)
        p, p0 = table["p"].to_numpy(), table["p0"].to_numpy()
        reach = np.repeat(ends, ends - starts) - np.arange(table.num_rows) - 1  # later rows of the same term
        upto, a = np.cumsum(reach), 0
        while a < table.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            g = np.repeat(np.arange(a, b), reach[a:b])
            h = g + 1 + np.arange(len(g)) - np.repeat(np.cumsum(reach[a:b]) - reach[a:b], reach[a:b])
            part = np.abs(p[g] - p[h]) - np.abs(p[g] - p0[h]) - np.abs(p0[g] - p[h]) + np.abs(p0[g] - p0[h])
            keys, where = np.unique(own[g] << 32 | own[h], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, where, part)
            for key, v in zip(keys.tolist(), sums.tolist(), strict=True):
                held[key] = held.get(key, 0) + v
            if len(held) >= HELD:
                yield from flush()
            a = b
    yield from flush()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms))`` in decimals; 0 where no term is kept."""
    big = lambda c: c.cast("decimal(19,0)")
    upper = F.lit(UNIT).cast("decimal(10,0)") * big(n + PRIOR)
    return F.when(terms > 0, 1 + F.call_function("div", upper, big(total + PRIOR * terms))).otherwise(F.lit(0).cast("long"))


def kept_terms(docs: DataFrame, lang_col: str, source_col: str, text_col: str, least: int) -> DataFrame:
    """``lang, term, source, n, total, head``: occurrences of each kept term in each group that has it, in its language,
    and 1 on the first row of a term; written to the shared folder."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.monotonically_increasing_id().alias("document"), plain(text_col).alias("text"))
    runs = rows.mapInArrow(_count, _RUN).repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "document")  # the first column tells most rows apart
    return materialise(runs.mapInArrow(_frequent(least), "lang binary, term binary, source binary, n long, total long, head long"), "kept-terms")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each pair of sources of a language is apart (part ``pair``), and
    the ``top`` terms that a source uses more than its language does (part ``term``)."""
    kept = kept_terms(docs, lang_col, source_col, text_col, least)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    langs = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("lang_n"))
    counts = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("own_terms"))
    groups = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source")).distinct().join(counts, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["own_n", "own_terms", "terms", "lang_n"]).withColumn("p0", _share(F.lit(0).cast("long"), F.col("own_n"), F.col("terms")))
    groups = materialise(groups, "groups")
    seen = kept.join(groups.select("lang", "source", "own_n", "terms", "lang_n", "p0"), ["lang", "source"])
    seen = seen.select("lang", "term", "source", "p0", _share(F.col("n"), F.col("own_n"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"))

    together = seen.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(_pairs, "lang binary, source binary, item binary, value long")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    together = together.groupBy("lang", "source", "item").agg(exact(F.col("value")).alias("value"))
    # each group's distinct p with running counts and sums, and among them the p0 of every other group
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("x"))
    asked = groups.select("lang", "source", "p0", "own_terms", "terms").join(other, "lang").where("source <> item")
    values = seen.groupBy("lang", "source", F.col("p").alias("x")).agg(F.count("*").alias("k"))
    blank = lambda kind: F.lit(None).cast(kind)
    line = values.select("lang", "source", "x", "k", blank("binary").alias("item"), *(blank("long").alias(c) for c in ("p0", "own_terms", "terms")))
    line = line.unionByName(asked.select("lang", "source", "x", F.lit(0).cast("long").alias("k"), "item", "p0", "own_terms", "terms"))
    group = W.partitionBy("lang", "source")
    upto = group.orderBy("x").rangeBetween(W.unboundedPreceding, W.currentRow)
    worth = F.col("k").cast("decimal(38,0)") * F.col("x").cast("decimal(20,0)")
    worth = worth.cast("decimal(38,0)")
    line = line.withColumns({"k_low": F.sum("k").over(upto), "s_low": F.sum(worth).over(upto), "s_all": F.sum(worth).over(group), "k_all": F.sum("k").over(group)}).where(F.col("item").isNotNull())
    big = lambda c: F.col(c).cast("decimal(20,0)")
    beyond = big("x") * (2 * F.col("k_low") - F.col("k_all")) + F.col("s_all") - 2 * F.col("s_low")
    apart = F.abs(big("p0") - big("x"))
    half = line.select("lang", "source", "item", (beyond - apart * F.col("own_terms")).cast("decimal(38,0)").alias("value"), (apart * F.col("terms")).cast("decimal(38,0)").alias("base"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    first = half.select("lang", "source", "item", (F.col("value") + F.col("base")).cast("decimal(38,0)").alias("value"))
    pairs = first.unionByName(turned(half)).unionByName(together).unionByName(turned(together)).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = group.orderBy(F.desc("value"), F.col("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = seen.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = pairs.unionByName(terms.select(*pairs.columns))
    return out.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source")), "part", F.col("item").cast("string").alias("item"), "value", "rank")
