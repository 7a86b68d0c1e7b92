"""Best-fit packing with swap-based local search.

Documents become token ids once; only pieces over the limit are cut.  Only lengths matter to a packing, so the
whole table is one pool: it is packed from the counts of its lengths, ``limit`` of them at most, as patterns of
bins and how many bins have each.  That is best fit, longest piece first, and then improved: one-for-one and
two-for-one exchanges and moves between underfull bins, each of which raises the sum of squared fills, until
ceil(tokens / limit) bins are left or no such step is.  Pieces then take the places of their length by their
rank among those of that length; the shards that ranks are counted in do not change the bins.

Defined results: a null or empty text is one piece that holds the end token alone; rows that repeat an id
are packed each; a null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops as T
from .bpe import byte_letters
from ..storage import materialise

#: Shards that ranks within a length are counted in: their least number, and the pieces of one in larger tables.
SHARDS, SHARD_PIECES = 256, 65_536
MAX_UNITS = 500_000
#: Letters A to z and of Latin-1: composed already, and lower-cased one by one; then a full stop or comma.
_LATIN = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,]?)")


class WordIds:
    """Ids of white-space separated units: the tokenizer drops white space and no token spans it."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.letters = dict(enumerate(byte_letters()))
        self.stops = {x: np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ("", ".", ",")}

    def _word(self, word: str) -> bytes:
        """Ids of Latin letters alone: one pre-token, so the model's merges are all that is left to do."""
        letters = word.lower().encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()

    def learn(self, units: set[bytes]) -> None:
        rest = []
        for unit in units.difference(self.known):
            found = _LATIN.fullmatch(unit.decode())
            if found:
                core = found[1].encode()
                ids = self.known.get(core)
                if ids is None:
                    ids = self.known[core] = self._word(found[1])
                self.known[unit] = ids + self.stops[found[2]]
            else:
                rest.append(unit)
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for unit, e in zip(part, self.tokenizer.encode_batch_fast([u.decode() for u in part], add_special_tokens=False), strict=True):
                self.known[unit] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        if len(self.known) > MAX_UNITS:
            self.known.clear()
        # the tokenizer lower-cases anyway, but finds its special strings before that
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.known.__getitem__
        return [b"".join([*map(get, words), end]) for words in split]


@lru_cache(maxsize=2)
def word_ids(file: str) -> WordIds:
    return WordIds(file)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(file: str, limit: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = word_ids(file)
        for batch in batches:
            texts = T.string_column(batch.column(1)).cast(pa.large_binary())
            for part in T.slices(batch.column(1)):
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                encoded = coder.encode(texts.slice(part.first, part.n).to_pylist(), end)
                for d, ids in zip(batch.column(0).slice(part.first, part.n).to_pylist(), encoded, strict=True):
                    for k, at in enumerate(range(0, len(ids), 4 * limit)):
                        one = ids[at : at + 4 * limit]
                        doc.append(d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        if with_ids:
                            kept.append(one)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` tokens: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(file, limit, end_id, with_ids), _PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(i)
            if room > n:
                bisect.insort(free, (room - n, b))
        else:
            bins.append([i])
            if n < limit:
                bisect.insort(free, (limit - n, len(bins) - 1))
    return bins


def improve(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """``improve_counts`` of bins of item numbers."""
    patterns = Counter(tuple(sorted(Counter(lengths[i] for i in items).items(), reverse=True)) for items in bins if items)
    of_length: dict[int, list[int]] = {}
    for i in chain.from_iterable(bins):
        of_length.setdefault(lengths[i], []).append(i)
    return [[of_length[n].pop() for n, m in p for _ in range(m)] for p, k in improve_counts(patterns, limit).items() for _ in range(k)]


Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit_counts(counts: dict[int, int], limit: int) -> Counter[Pattern]:
    """``best_fit`` of so many pieces of each length: how many bins have each pattern.

    Bins of one room take pieces of one length alike, so they are filled together.
    """
    done: Counter[Pattern] = Counter()
    rooms: list[int] = []
    by_room: dict[int, list[tuple[Pattern, int]]] = {}

    def put(pattern: Pattern, bins: int, room: int) -> None:
        if not bins:
            return
        if room <= 0:
            done[pattern] += bins
            return
        if room not in by_room:
            bisect.insort(rooms, room)
        by_room.setdefault(room, []).append((pattern, bins))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                pattern, bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, pattern, bins = limit, (), left  # as many new bins as could be needed
            each = max(1, room // n)
            whole = min(bins, left // each)
            put((*pattern, (n, each)), whole, room - each * n)
            left, bins = left - whole * each, bins - whole
            if bins and left:
                put((*pattern, (n, left)), 1, room - left * n)
                left, bins = 0, bins - 1
            if pattern:
                put(pattern, bins, room)
    for room in rooms:
        for pattern, bins in by_room[room]:
            done[pattern] += bins
    return done


def _fill(pattern: Pattern) -> int:
    return sum(n * m for n, m in pattern)


def _changed(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    items = Counter(dict(pattern))
    items.subtract(out)
    items.update(into)
    return tuple(sorted(((n, m) for n, m in items.items() if m), reverse=True))


class _Pool:
    """Underfull bins by pattern, in the order in which patterns came up; their items in flat arrays.

    ``seen[g]`` tells up to which pattern the bins of ``g`` were tried in vain, so that only later ones are
    tried again.  An item of length 0 ends each pattern: an exchange for it is a move.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.patterns: list[Pattern] = []
        self.number: dict[Pattern, int] = {}
        self.seen: list[int] = []
        self.first: list[int] = [0]
        self.bins, self.fill = np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.item, self.owner = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.heap: list[tuple[int, int]] = []

    def add(self, pattern: Pattern, bins: int) -> None:
        g = self.number.get(pattern)
        if g is None:
            g = self.number[pattern] = len(self.patterns)
            start, end = self.first[g], self.first[g] + len(pattern) + 1
            if g == len(self.bins):
                self.bins, self.fill = (np.concatenate([x, np.zeros_like(x)]) for x in (self.bins, self.fill))
            while end > len(self.item):
                self.item, self.owner = (np.concatenate([x, np.zeros_like(x)]) for x in (self.item, self.owner))
            self.patterns.append(pattern)
            self.seen.append(0)
            self.first.append(end)
            self.fill[g] = _fill(pattern)
            self.item[start:end] = [*(n for n, _ in pattern), 0]
            self.owner[start:end] = g
        elif self.bins[g] == 1:  # from now on it has a partner of its own pattern
            self.seen[g] = min(self.seen[g], g)
        self.bins[g] += bins
        heapq.heappush(self.heap, (int(self.fill[g]), g))

    def take(self, g: int, bins: int) -> None:
        self.bins[g] -= bins
        if not self.bins[g]:
            del self.number[self.patterns[g]]

    def emptiest(self) -> int | None:
        """The emptiest pattern with bins that were not tried with all others."""
        for again in (False, True):
            if again:
                self.compact()
                self.heap = [(int(self.fill[g]), g) for g in self.number.values() if self.seen[g] < len(self.patterns)]
                heapq.heapify(self.heap)
            while self.heap:
                g = heapq.heappop(self.heap)[1]
                if self.bins[g] and self.seen[g] < len(self.patterns):
                    return g
        return None

    def compact(self) -> None:
        """Forget patterns without bins."""
        if len(self.patterns) < 2 * len(self.number) + 64:
            return
        live = [g for g in range(len(self.patterns)) if self.bins[g]]
        before = np.concatenate([[0], np.cumsum(self.bins[: len(self.patterns)] > 0)])
        kept = [(self.patterns[g], int(self.bins[g]), int(before[self.seen[g]])) for g in live]
        self.__init__(self.limit)
        for pattern, bins, _ in kept:
            self.add(pattern, bins)
        self.seen = [seen for _, _, seen in kept]

    def step(self, g: int) -> tuple[int, tuple[int, ...], int] | None:
        """The best exchange of ``g``, as pattern, items that go there and length that comes back, 0 for none."""
        pattern = self.patterns[g]
        own = np.array([n for n, _ in pattern], np.int64)
        a, b = np.triu_indices(len(own))
        ok = (a != b) | (np.array([m for _, m in pattern]) > 1)[a]
        a, b = a[ok], b[ok]
        sums, which = np.unique(np.concatenate([own, own[a] + own[b]]), return_index=True)
        begin, end = self.first[self.seen[g]], self.first[len(self.patterns)]
        back, to = self.item[begin:end], self.owner[begin:end]
        fill = self.fill[to]
        # the gain grows with what the other bin gets, so of all sums only the largest that fits counts
        at = np.searchsorted(sums, back + self.limit - fill, "right") - 1
        d = sums[at] - back
        gain = d * (fill - self.fill[g] + d)
        gain[(at < 0) | (d <= 0) | (self.bins[to] < np.where(to == g, 2, 1))] = 0
        k = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[k] <= 0:
            self.seen[g] = len(self.patterns)
            return None
        w = int(which[at[k]])
        out = (int(own[w]),) if w < len(own) else (int(own[a[w - len(own)]]), int(own[b[w - len(own)]]))
        return int(to[k]), out, int(back[k])


def improve_counts(bins: Counter[Pattern], limit: int) -> Counter[Pattern]:
    """Local search: each step takes an exchange that raises the sum of squared fills the most, emptiest bins first.

    Bins of one pattern take a step together.  It ends at ceil(tokens / limit) bins or when no bin has a step left.
    """
    done: Counter[Pattern] = Counter()
    pool = _Pool(limit)

    def add(pattern: Pattern, n: int) -> None:
        if _fill(pattern) >= limit:
            done[pattern] += n
        elif pattern:
            pool.add(pattern, n)

    for pattern in sorted(bins):
        add(tuple(sorted(pattern, reverse=True)), bins[pattern])
    live = sum(bins.values())
    fewest = -(-sum(_fill(p) * n for p, n in bins.items()) // limit)
    while live > fewest:
        g = pool.emptiest()
        if g is None:
            break
        found = pool.step(g)
        if found is None:
            continue
        h, out, back = found
        source, other = pool.patterns[g], pool.patterns[h]
        n = int(pool.bins[g]) // 2 if g == h else int(min(pool.bins[g], pool.bins[h]))
        pool.take(g, n)
        pool.take(h, n)
        back = (back,) if back else ()
        left = _changed(source, out, back)
        add(left, n)
        add(_changed(other, back, out), n)
        if not left:
            live -= n
        if pool.bins[g]:
            heapq.heappush(pool.heap, (int(pool.fill[g]), g))
    for pattern, g in pool.number.items():
        done[pattern] += int(pool.bins[g])
    return done


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_RANKS = 1 << 44


def _places(bins: Counter[Pattern]) -> np.ndarray:
    """Rows of length and first rank as one key, first bin, pieces a bin, first offset; ascending by key.

    A pattern's bins are numbered on; of each length, ranks count the places from 0 in the order of bins.
    """
    rows, rank, first = [], Counter(), 0
    for pattern in sorted(bins):
        offset = 0
        for n, m in pattern:
            rows.append((n * _RANKS + rank[n], first, m, offset))
            rank[n] += m * bins[pattern]
            offset += n * m
        first += bins[pattern]
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


def _place(places: np.ndarray):
    def run(pieces: pa.Table, ranks: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        length = pieces.column("length").to_numpy()
        by_length = ranks.sort_by("of_length")
        base, n = by_length.column("first").to_numpy(), by_length.column("n").to_numpy()
        rank = np.arange(len(length)) - np.repeat(np.cumsum(n) - n - base, n)
        keys, first, each, offset = places
        at = np.searchsorted(keys, length * _RANKS + rank, "right") - 1
        rank = rank - keys[at] % _RANKS
        kept = pieces.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(first[at] + rank // each[at])).append_column("offset", pa.array(offset[at] + rank % each[at] * length))

    return run


def pack(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; a sequence holds at most ``limit`` tokens, gapless from 0."""
    pieces = materialise(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _places(improve_counts(best_fit_counts(counts, limit), limit))
    shards = max(SHARDS, -(-sum(counts.values()) // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    ranks = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    first = F.sum("n").over(W.partitionBy("length").orderBy("shard")) - F.col("n")
    # under names of their own: columns that both sides share are pruned wrongly when few of the result are asked for
    ranks = ranks.select(F.col("shard").alias("in_shard"), F.col("length").alias("of_length"), "n", first.alias("first"))
    return dealt.groupBy("shard").cogroup(ranks.groupBy("in_shard")).applyInArrow(_place(places), _PACKED)
