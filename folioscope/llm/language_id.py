"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of contexts of up to ``ORDER`` bytes.  Training counts, over all training documents, every
``ORDER + 1`` consecutive bytes (zeros stand before a text); counts of shorter ones are their sums.  A tree keeps, of
each length, byte strings that make up at least a fixed share of the language, so it is bounded however much is read.
In a context seen ``t`` times with ``d`` kept successors, a kept successor seen ``n`` times has probability
``n / (t + d)``; what is left is the probability to escape to the context without its first byte, and below the empty
context all bytes are equally likely.  Statistics are frozen: a text's code length in a language is the sum of fixed
costs, one per byte, in whole units of 2^-16 bits, so it does not depend on the order of addition.

The trees are compiled to one table: a row per byte string that any language keeps, with each language's cost of its
last byte after the others, and of the escape from it as a context.  The language with the shortest code is predicted.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing can be
learnt; of equally long codes the language that sorts first wins; the score is the winner's share of 2 to the power of
minus the code lengths; a null id counts as an empty one, which is held out; an empty language name is a language; bytes
that are not UTF-8 are bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import textops as T

#: Longest context; at most so many byte strings of a length are kept per language, and cells of the whole table.
ORDER, STRINGS, CELLS = 3, 1 << 16, 1 << 24
FOLDS = 5
UNIT = 1 << 16
CHUNK = 1 << 20
#: Distinct strings that a task combines before it hands them on.
HELD = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _strings(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte the number made of the ``order`` bytes before it and itself; zeros stand before ``starts``."""
    out = data.astype(np.uint64)
    for j in range(1, order + 1):
        back = np.zeros(len(data), np.uint64)
        back[j:] = data[:-j] if j < len(data) else 0
        for t in range(j):
            at = starts + t
            back[at[at < len(data)]] = 0
        out |= back << np.uint64(8 * j)
    return out


def _chunks(part: T.Slice, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings of a slice, with the document of each; a long document comes in chunks that overlap by its context."""
    lengths = np.diff(part.offsets)
    document = np.repeat(np.arange(part.n), lengths)
    starts = part.offsets[:-1][lengths > 0]
    for a in range(0, len(part.data), CHUNK):
        b, lead = min(a + CHUNK, len(part.data)), min(a, order)
        own = starts[(starts >= a - lead) & (starts < b)] - (a - lead)
        yield _strings(part.data[a - lead : b], own, order)[lead:], document[a:b]


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def string_counts(rows: DataFrame, order: int) -> DataFrame:
    """``lang, string, n``: how often each language has each string of ``order + 1`` bytes in ``rows(lang, text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        keys, counts, fresh, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        shift, mask = np.uint64(8 * (order + 1)), np.uint64((1 << 8 * (order + 1)) - 1)

        def merge() -> None:
            nonlocal keys, counts, fresh, waiting
            new, where = np.unique(np.concatenate([keys, *(k for k, _ in fresh)]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, *(n for _, n in fresh)]), len(new)).astype(np.int64)  # exact below 2^53
            keys, fresh, waiting = new, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            names = np.array(list(langs), dtype=object)
            for a in range(0, len(keys), 50_000):
                own = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(names[(own >> shift).astype(np.int64)], pa.string()), pa.array((own & mask).astype(np.int64)), pa.array(counts[a : a + 50_000])], ["lang", "string", "n"])
            keys, counts = keys[:0], counts[:0]

        for batch in batches:
            own = np.array([langs.setdefault(x, len(langs)) for x in batch["lang"].to_pylist()], np.uint64)
            for part in T.slices(batch["text"], CHUNK):
                for strings, document in _chunks(part, order):
                    found, n = np.unique(strings | own[part.first + document] << shift, return_counts=True)
                    fresh.append((found, n))
                    waiting += len(found)
                    if waiting >= HELD:
                        merge()
                        if len(keys) >= HELD:
                            yield from flush()
        merge()
        yield from flush()

    return rows.mapInArrow(count, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def context_trees(rows: DataFrame, order: int = ORDER, strings: int = STRINGS, cells: int = CELLS) -> tuple[list[str], np.ndarray, list[dict[str, np.ndarray]]]:
    """Languages, sorted, their bytes, and for each length 1 to ``order + 1`` the kept strings of all languages: ``lang``
    (number), ``string``, ``n`` (0 if the string is kept as a context alone), and ``seen``, how often a byte follows.

    Where a language keeps a string it keeps the context and the end of it, since they are at least as frequent.
    """
    counts = materialise(string_counts(rows, order), "byte-strings")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    langs = sorted(totals)
    if not langs:
        return [], np.zeros(0, np.int64), []
    limit = max(1, min(strings, cells // (len(langs) ** 2 * (order + 1))))
    total = counts.sparkSession.createDataFrame([(x, i, totals[x]) for i, x in enumerate(langs)], "lang string, number int, total long")
    counts = counts.join(F.broadcast(total), "lang").select("number", "total", "string", "n")  # a row per language
    part = lambda length, skip: F.shiftright("string", 8 * skip).bitwiseAND(F.lit((1 << 8 * length) - 1)).alias("string")
    levels = []
    for length in range(1, order + 2):
        each = counts.select("number", "total", part(length, 0), "n", F.lit(0).cast("long").alias("seen"))
        if length <= order:
            each = each.unionByName(counts.select("number", "total", part(length, 1), F.lit(0).cast("long").alias("n"), F.col("n").alias("seen")))
        often = lambda c: F.col(c).cast("decimal(38,0)") * limit >= F.col("total")
        kept = each.groupBy("number", "total", "string").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).where(often("n") | often("seen"))
        kept = kept.select(F.col("number").alias("lang"), "string", F.when(often("n"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("n"), "seen")
        found = kept.toArrow()  # per language at most ``limit`` rows, and one for the zeros before a text
        levels.append({c: found[c].to_numpy().astype(np.uint64 if c == "string" else np.int64) for c in found.column_names})
    return langs, np.array([totals[x] for x in langs], np.int64), levels


def _bits(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The cost of a probability ``n / of``; 0 where there is none to pay."""
    return np.where((n > 0) & (of > 0), np.rint(np.log2(np.maximum(of, 1) / np.maximum(n, 1)) * UNIT), 0).astype(np.int32)


class Costs:
    """All languages' frozen costs.  ``tables[n]`` are the strings of ``n`` bytes that any language keeps, sorted; rows of
    ``cost[n]`` are each language's cost of their last byte after the others, of ``escape[n]`` that of going from them, as a
    context, to the one without the first byte."""

    def __init__(self, totals: np.ndarray, levels: list[dict[str, np.ndarray]]):
        self.n_langs, self.order = len(totals), len(levels) - 1
        self.tables, self.cost, self.escape = [np.zeros(1, np.uint64)], [np.full((1, self.n_langs), 8 * UNIT, np.int32)], []
        context_seen = totals[None, :]
        for length, level in enumerate(levels, 1):
            table = np.unique(level["string"])
            at = np.searchsorted(table, level["string"])
            n, seen = np.zeros((len(table), self.n_langs), np.int64), np.zeros((len(table), self.n_langs), np.int64)
            n[at, level["lang"]], seen[at, level["lang"]] = level["n"], level["seen"]
            above = self.tables[-1]
            context = np.searchsorted(above, table >> np.uint64(8))
            suffix = np.searchsorted(above, table & np.uint64((1 << 8 * (length - 1)) - 1))
            kinds, kept = np.zeros((len(above), self.n_langs), np.int64), np.zeros((len(above), self.n_langs), np.int64)
            np.add.at(kinds, (context[at], level["lang"]), level["n"] > 0)
            np.add.at(kept, (context[at], level["lang"]), level["n"])
            self.escape.append(_bits(context_seen - kept + kinds, context_seen + kinds))
            self.cost.append(np.where(n > 0, _bits(n, (context_seen + kinds)[context]), self.escape[-1][context] + self.cost[-1][suffix]))
            self.tables.append(table)
            context_seen = seen
        self.index = [self._places(t) for t in self.tables]

    @staticmethod
    def _places(table: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """Open addressing: the number of each string at its hash, or at the next place that was free."""
        bits = max(4, int(len(table) * 4).bit_length())
        shift, places = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        at, left = ((table * _MIX) >> shift).astype(np.int64), np.arange(len(table))
        while len(left):
            free = left[places[at[left]] < 0]
            places[at[free]] = free  # of several the last stays
            left = left[places[at[left]] != left]
            at[left] = (at[left] + 1) & (len(places) - 1)
        return places, shift

    def find(self, length: int, strings: np.ndarray) -> np.ndarray:
        """The row of each string, or -1."""
        table, (places, shift) = self.tables[length], self.index[length]
        at = ((strings * _MIX) >> shift).astype(np.int64)
        found = places[at]
        left = np.flatnonzero((found >= 0) & (table[found] != strings))
        while len(left):
            at[left] = (at[left] + 1) & (len(places) - 1)
            found[left] = places[at[left]]
            left = left[(found[left] >= 0) & (table[found[left]] != strings[left])]
        return found

    def add(self, strings: np.ndarray, document: np.ndarray, out: np.ndarray) -> None:
        """Add the cost of each string's last byte to the row of ``out`` of its document; documents ascend."""
        for n in range(self.order + 1, -1, -1):
            found = self.find(n, strings)
            self._sum(self.cost[n], found, document, out)
            left = found < 0
            strings, document = strings[left], document[left]
            if not len(strings):
                return
            self._sum(self.escape[n - 1], self.find(n - 1, strings >> np.uint64(8)), document, out)
            strings = strings & np.uint64((1 << 8 * (n - 1)) - 1)

    def _sum(self, costs: np.ndarray, found: np.ndarray, document: np.ndarray, out: np.ndarray) -> None:
        if (found < 0).any():
            document, found = document[found >= 0], found[found >= 0]
        step = max(1, (4 * CHUNK) // self.n_langs)
        for a in range(0, len(found), step):
            own = document[a : a + step]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[starts]] += np.add.reduceat(costs[found[a : a + step]], starts, dtype=np.int64)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, order: int = ORDER, strings: int = STRINGS, cells: int = CELLS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, bits_per_byte``.

    Documents whose checksum is 0 modulo ``folds`` are held out of training, as are those without a language.
    """
    spark = docs.sparkSession
    out = held_out(F.col(id_col), folds)
    langs, totals, levels = context_trees(docs.where(~out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), order, strings, cells)
    model = spark.sparkContext.broadcast(Costs(totals, levels) if langs else None)  # ``cells`` numbers at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = model.value
        for batch in batches:
            n = batch.num_rows
            spelt = np.array([t is not None and any(map(str.isalpha, t)) for t in batch["text"].to_pylist()], bool) & bool(langs)
            bits, sizes = np.zeros((n, max(len(langs), 1)), np.int64), np.zeros(n, np.int64)
            if langs:
                for part in T.slices(batch["text"], CHUNK):
                    own = bits[part.first : part.first + part.n]
                    sizes[part.first : part.first + part.n] = np.diff(part.offsets)
                    for strings_, document in _chunks(part, order):
                        costs.add(strings_, document, own)
            best = bits.argmin(axis=1)  # the first of equals
            behind = (bits - bits[np.arange(n), best][:, None]) / UNIT
            share = 1 / np.exp2(-np.minimum(behind, 1000.0)).sum(axis=1)
            names = np.array([*langs, "und"], dtype=object)
            rate = bits[np.arange(n), best] / UNIT / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names[np.where(spelt, best, len(langs))], pa.string()), pa.array(np.where(spelt, share, 0.0)), pa.array(rate)],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, bits_per_byte double")
