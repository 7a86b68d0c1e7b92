"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are cut into stretches of neighbouring windows of ``width`` words that share an *anchor*, the
smallest hash of the shorter word runs in a window.  Stretches are dealt to *reference blocks* by anchor, so
equal windows of all documents meet in one block whatever surrounds them, and a document is parsed against
every block that can hold a factor of it.  A block indexes its windows; an entry of the index is accepted
only when all its words equal those of the place looked up.  Documents are then parsed greedily against it,
in the order of ids: a factor starts at a window that occurs earlier, refers to the earliest place, and
grows for as long as the words go on alike there; at its end the next window is looked up again, so windows
across the boundary of two factors are not lost.  Factors of ``width`` words or more are duplicate spans.

Words travel with the stretches, as numbers of the sample's frequent words and spelt out otherwise, so
nothing is decided by hashes: they find candidates and route.  Copies inside one slice of documents are settled there and only a slice's first
instance is sent on, so a group of copies shows up once per slice.  Anchors that a bounded sample of
documents shows to be frequent are passed over for the next smallest in the window (or the window's own
hash, if all are), so what surrounds a common phrase does not gather in one block.  The sample and the
number of blocks decide where stretches go, never the result.

Defined results: a null or wordless text has no words; a null id sorts after all ids; rows that repeat an
id are at the same place, so neither removes the other's window at the same start (they are told apart by a
32-bit hash of their text); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shuffle_partitions
from . import textops as T

NULL_ID = (1 << 63) - 1
ANCHOR_WORDS = 4
#: Text of a slice of documents that is settled at once, and of a reference block.
SLICE_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20
#: Documents of the sample in expectation, and how many of its stretches make an anchor frequent.
SAMPLE_DOCUMENTS, FREQUENT = 20_000, 64
#: Words that are sent as numbers: at most so many, of so many bytes at most, and seen so often in the sample.
COMMON_WORDS, COMMON_BYTES, COMMON_SEEN = 1 << 16, 32, 4
_CHUNK = 1 << 20
_ALL = np.uint64((1 << 64) - 1)

PIECES = "id long, mark int, start int, n int, ref_id long, ref_start int"
_ENTRY = pa.schema([("block", pa.int32()), ("message", pa.binary())])
_PIECE_TYPES = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int32)
_PIECE = pa.schema([("id", pa.int64()), ("mark", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])


def _pack(arrays: list[np.ndarray]) -> bytes:
    body = b"".join(x.tobytes() for x in arrays)
    head = struct.pack("<qB", len(body), len(arrays)) + b"".join(struct.pack("<cBq", x.dtype.char.encode(), x.itemsize, len(x)) for x in arrays)
    return head + pa.Codec("zstd", 1).compress(body, asbytes=True)


def _unpack(message: bytes) -> list[np.ndarray]:
    size, n = struct.unpack_from("<qB", message)
    fields = [struct.unpack_from("<cBq", message, 9 + 10 * i) for i in range(n)]
    body, at, out = pa.Codec("zstd").decompress(message[9 + 10 * n :], size), 0, []
    for char, width, length in fields:
        out.append(np.frombuffer(body, char.decode(), length, at))
        at += width * length
    return out


def even_keys(n: int) -> np.ndarray:
    """Numbers of which Spark's hash (Murmur3 with seed 42) puts the i-th into partition i of ``n``.

    Were it another hash, partitions would only be less even.
    """
    keys, mask = np.full(n, -1, np.int64), np.uint64(0xFFFFFFFF)
    turn = lambda x, r: (x << np.uint64(r) | x >> np.uint64(32 - r)) & mask
    first = 0
    while (keys < 0).any():
        x = np.arange(first, first + 8 * n, dtype=np.uint64)
        h = np.uint64(42) ^ turn(x * np.uint64(0xCC9E2D51) & mask, 15) * np.uint64(0x1B873593) & mask
        h = (turn(h, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & mask ^ np.uint64(4)
        h = (h ^ h >> np.uint64(16)) * np.uint64(0x85EBCA6B) & mask
        h = (h ^ h >> np.uint64(13)) * np.uint64(0xC2B2AE35) & mask
        h = (h ^ h >> np.uint64(16)).astype(np.uint32).view(np.int32).astype(np.int64) % n
        place, at = np.unique(h, return_index=True)
        new = keys[place] < 0
        keys[place[new]] = first + at[new]
        first += 8 * n
    return keys


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The low bytes of all numbers, then the next, and so on: small numbers compress better that way."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).ravel()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _earliest(hashes: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each window the first window of equal words; ``equal`` compares the words of pairs of windows."""
    out, left = np.arange(len(hashes)), np.arange(len(hashes))
    while len(left):
        order = left[np.argsort(hashes[left], kind="stable")]
        ordered = hashes[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        again = ~fresh
        order, first = order[again], first[again]
        same = equal(order, first)
        out[order[same]] = first[same]
        left = np.sort(order[~same])  # other words under an equal hash: the first of these is looked for again
    return out


def _parse(first: np.ndarray, ids: np.ndarray, places: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors over windows in the order of documents: first window, number of windows, reference.

    ``follows`` says that a window continues the one before it.  Of windows of equal words (that is, an
    equal ``first``) the earliest is the reference.  A factor goes on while the next window equals that
    after its reference.
    """
    repeated = (ids != ids[first]) | (places != places[first])
    joined = np.zeros(len(first), bool)
    joined[1:] = follows[1:] & repeated[1:] & repeated[:-1] & (first[1:] == first[:-1] + 1) & follows[first[1:]]
    starts = np.flatnonzero(repeated & ~joined)
    total = np.concatenate([[0], np.cumsum(repeated)])
    sizes = np.diff(np.append(total[starts], total[-1]))
    refs = first[starts]
    if len(starts) < 2:
        return starts, sizes, refs
    meets = np.flatnonzero((starts[1:] == starts[:-1] + sizes[:-1]) & follows[starts[1:]]) + 1
    gone = np.zeros(len(starts), bool)
    head = np.arange(len(starts))
    for i in meets.tolist():  # a factor whose end meets the next: does its reference go on alike?
        h = head[i - 1]
        step = starts[i] - starts[h]
        ahead = refs[h] + step + np.arange(sizes[i])
        if ahead[-1] < len(first) and follows[ahead].all() and (first[ahead] == first[starts[i] : starts[i] + sizes[i]]).all():
            head[i], gone[i] = h, True
            sizes[h] += sizes[i]
    return starts[~gone], sizes[~gone], refs[~gone]


def _factor_rows(parsed, ids, marks, places) -> tuple[np.ndarray, ...]:
    starts, sizes, refs = parsed
    out = ids[starts], marks[starts], places[starts], sizes, ids[refs], places[refs]
    return tuple(x.astype(k) for x, k in zip(out, _PIECE_TYPES, strict=True))


def _vocabulary(part: T.Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a slice, and for each of its words the number there."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    values = part.data[~T.IS_SPACE[part.data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of an array of words without an offset of its own."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.diff(offsets), data


def _word_hashes(part: T.Slice) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Hashes of a slice's words, its vocabulary, the words' numbers there, and each document's first word."""
    starts, ends, first_word = T.words(part)
    vocabulary, codes = _vocabulary(part, starts, ends)
    lengths, data = _bytes_of(vocabulary)
    stops = np.cumsum(lengths)
    return T.word_hashes(data, stops - lengths, stops)[codes] if len(codes) else np.zeros(0, np.uint64), vocabulary, codes, first_word


def _anchors(hashes: np.ndarray, at: np.ndarray, whole: np.ndarray, width: int, anchor: int, frequent: np.ndarray) -> np.ndarray:
    """For each window from word ``at`` the smallest hash of ``anchor`` words in it that is not frequent."""
    short = T.window_hashes(hashes, anchor)
    if len(frequent):
        short[frequent[np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)] == short] = _ALL
    low = T.sliding_min(short, width - anchor + 1)[at]
    return np.where(low == _ALL, whole, low)


def _stretches(low: np.ndarray, document: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one anchor: first window and number of windows."""
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (document[1:] != document[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(fresh)
    return first, np.diff(np.append(first, len(low)))


def _gather(heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places ``head, head + 1, ...``, ``count`` of them for each head, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(heads - before, counts) + np.arange(counts.sum())


def _dealt(block: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """An order by block, and where in it each block that occurs begins and ends."""
    order = np.argsort(block, kind="stable")
    found, begin = np.unique(block[order], return_index=True)
    end = np.append(begin, len(block))[1:]
    return order, dict(zip(found.tolist(), zip(begin.tolist(), end.tolist(), strict=True), strict=True))


def _settle(part: T.Slice, ids: np.ndarray, marks: np.ndarray, width: int, anchor: int, blocks: np.ndarray, frequent: np.ndarray, common: pa.Array) -> Iterator[tuple[int, bytes]]:
    """A slice's own factors and the stretches that it sends on, as messages to those of ``blocks`` that occur."""
    hashes, vocabulary, codes, first_word = _word_hashes(part)
    at, document = T.window_documents(first_word, width)
    if not len(at):
        return
    place = at - first_word[document]
    if (ids[1:] < ids[:-1]).any():
        rank = np.lexsort((place, ids[document]))
        at, document, place = at[rank], document[rank], place[rank]
    whole = T.window_hashes(hashes, width)[at]

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, x, y = np.ones(len(a), bool), at[a], at[b]
        for k in range(width):
            out &= codes[x + k] == codes[y + k]
        return out

    first = _earliest(whole, equal)
    doc_ids = ids[document]
    follows = np.zeros(len(at), bool)
    follows[1:] = (document[1:] == document[:-1]) & (place[1:] == place[:-1] + 1)
    factors = _factor_rows(_parse(first, doc_ids, place, follows), doc_ids, marks[document], place)
    by_factor, factor_bounds = _dealt(blocks[(T.mix(factors[0].astype(np.uint64)) % np.uint64(len(blocks))).astype(np.int64)])
    factors = [x[by_factor] for x in factors]

    sent = np.flatnonzero(first == np.arange(len(at)))
    at, document, place = at[sent], document[sent], place[sent]
    low = _anchors(hashes, at, whole[sent], width, anchor, frequent)
    heads, counts = _stretches(low, document, place)
    order, bounds = _dealt(blocks[(T.mix(low[heads]) % np.uint64(len(blocks))).astype(np.int64)])
    heads, counts = heads[order], counts[order]
    stretches = [ids[document[heads]].astype(np.int64), marks[document[heads]].astype(np.int32), place[heads].astype(np.int32), counts.astype(np.int32)]
    long = counts + width - 1
    ahead = np.concatenate([[0], np.cumsum(long)])
    sequence = codes[_gather(at[heads], long)]
    number = pc.fill_null(pc.index_in(vocabulary, value_set=common), -1).to_numpy(zero_copy_only=False)
    for block in sorted(bounds.keys() | factor_bounds.keys()):
        a, b = bounds.get(block, (0, 0))
        c, d = factor_bounds.get(block, (0, 0))
        own = sequence[ahead[a] : ahead[b]]
        numbers = number[own]
        spelt = np.flatnonzero(numbers < 0)
        rare = pa.array(own[spelt]).dictionary_encode()
        numbers[spelt] = len(common) + rare.indices.to_numpy(zero_copy_only=False)
        lengths, data = _bytes_of(vocabulary.take(rare.dictionary))
        yield block, _pack([*(x[a:b] for x in stretches), _planes(numbers), lengths.astype(np.int32), data, *(x[c:d] for x in factors)])


def _entries(width: int, anchor: int, blocks: np.ndarray, frequent: np.ndarray, common: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for part in T.slices(batch.column(2), SLICE_BYTES):
                own = slice(part.first, part.first + part.n)
                rows = list(_settle(part, ids[own], marks[own], width, anchor, blocks, frequent, common))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], schema=_ENTRY)

    return run


def _window_hashes(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows from words ``at``, a chunk at a time."""
    values = T.mix(np.arange(codes.max() + 1, dtype=np.uint64))
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), _CHUNK):
        here = at[i : i + _CHUNK]
        a, b = int(here.min()), int(here.max()) + width
        out[i : i + _CHUNK] = T.window_hashes(values[codes[a:b]], width)[here - a]
    return out


def _block(width: int, n_common: int):
    """The parse against a reference block, made of all messages to it; ``n_common`` words have numbers."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in table.column("message").to_pylist()]
        forwarded = [np.concatenate([p[7 + i] for p in parts]) for i in range(6)]
        ids, marks, places, counts = (np.concatenate([p[i] for p in parts]) for i in range(4))
        counts = counts.astype(np.int64)
        lengths = np.concatenate([p[5] for p in parts])
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([p[6] for p in parts]))])
        known = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
        base = np.cumsum([0, *(len(p[5]) for p in parts)])
        codes = np.concatenate([_from_planes(p[4]) for p in parts])
        message = np.repeat(base[:-1], [len(p[4]) // 4 for p in parts])
        rare = np.flatnonzero(codes >= n_common)
        codes[rare] = n_common + known[message[rare] + codes[rare] - n_common]
        del message, rare
        del parts, words, known
        behind = np.cumsum(counts + width - 1) - (counts + width - 1)
        order = np.lexsort((places, ids))
        counts, behind, places, ids, marks = counts[order], behind[order], places[order].astype(np.int64), ids[order], marks[order]
        at = _gather(behind, counts)
        stretch = np.repeat(np.arange(len(counts)), counts)
        place = _gather(places, counts)
        follows = np.ones(len(at), bool)
        follows[np.cumsum(counts) - counts] = False

        def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out, x, y = np.ones(len(a), bool), at[a], at[b]
            for k in range(width):
                out &= codes[x + k] == codes[y + k]
            return out

        first = _earliest(_window_hashes(codes, at, width), equal) if len(at) else np.zeros(0, np.int64)
        ids, marks = ids[stretch], marks[stretch]
        found = _factor_rows(_parse(first, ids, place, follows), ids, marks, place)
        return pa.Table.from_arrays([pa.array(np.concatenate([a, b])) for a, b in zip(found, forwarded, strict=True)], schema=_PIECE)

    return run


def _sampled(width: int, anchor: int):
    """Of each slice of the sample: bytes of texts, how many stretches an anchor has, and how often a word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(0), SLICE_BYTES):
                hashes, vocabulary, codes, first_word = _word_hashes(part)
                at, document = T.window_documents(first_word, width)
                found, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(at):
                    low = _anchors(hashes, at, T.window_hashes(hashes, width)[at], width, anchor, found)
                    heads, _ = _stretches(low, document, at)
                    found, n = np.unique(low[heads], return_counts=True)
                found = np.concatenate([found, [_ALL]])
                n = np.concatenate([n, [len(part.data)]])
                short = np.flatnonzero(_bytes_of(vocabulary)[0] <= COMMON_BYTES)
                words = vocabulary.take(pa.array(short)).cast(pa.binary())
                often = np.bincount(codes, minlength=len(vocabulary))[short]
                anchors = pa.concat_arrays([pa.array(found.view(np.int64)), pa.nulls(len(short), pa.int64())])
                words = pa.concat_arrays([pa.nulls(len(found), pa.binary()), words])
                yield pa.RecordBatch.from_arrays([anchors, words, pa.array(np.concatenate([n, often]).astype(np.int64))], names=["anchor", "word", "n"])

    return run


def sampled(docs: DataFrame, text_col: str, width: int, anchor: int) -> tuple[int, np.ndarray, pa.Array]:
    """Bytes of all texts, estimated; and of a sample of ``SAMPLE_DOCUMENTS`` documents the frequent anchors and words.

    Each frequent anchor has ``FREQUENT`` stretches in the sample, whose size does not grow with the table, and
    of words there are ``COMMON_WORDS`` at most, so both lists are bounded.
    """
    rows = docs.count()
    if not rows:
        return 0, np.zeros(0, np.uint64), pa.array([], pa.large_binary())
    share = min(1.0, SAMPLE_DOCUMENTS / rows)
    texts = docs.select(F.col(text_col).alias("text"))
    seen = (texts if share == 1.0 else texts.sample(share, seed=23)).mapInArrow(_sampled(width, anchor), "anchor long, word binary, n long")
    worth = F.when(F.col("word").isNotNull(), F.col("n") >= COMMON_SEEN).otherwise((F.col("n") >= FREQUENT) | (F.col("anchor") == -1))
    found = seen.groupBy("anchor", "word").agg(F.sum("n").alias("n")).where(worth).collect()
    anchors = np.array([r.anchor for r in found if r.word is None and r.anchor != -1], np.int64).view(np.uint64)
    words = sorted(((-r.n, bytes(r.word)) for r in found if r.word is not None))[:COMMON_WORDS]
    size = sum(r.n for r in found if r.word is None and r.anchor == -1)
    return int(size / share), np.sort(anchors), pa.array([w for _, w in words], pa.large_binary())


_KEPT = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,n_words:int,ref_id:long,ref_start:int>>"


def _factors(pieces: list[dict], width: int) -> list[dict]:
    """Greedy parse of one document: pieces that touch and go on at the same reference are one factor."""
    out: list[dict] = []
    for p in sorted(pieces, key=lambda p: (p["start"], p["ref_id"], p["ref_start"])):
        last = out[-1] if out else None
        if last and last["ref_id"] == p["ref_id"] and last["ref_start"] - last["start"] == p["ref_start"] - p["start"] and p["start"] <= last["start"] + last["n_words"] - width + 1:
            last["n_words"] = max(last["n_words"], p["start"] + p["n"] + width - 1 - last["start"])
        else:
            out.append({"start": p["start"], "n_words": p["n"] + width - 1, "ref_id": p["ref_id"], "ref_start": p["ref_start"]})
    return out


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.string_column(batch.column(1)).cast(pa.large_binary())
            counts, removed, kept, factors = [], [], [], []
            for text, pieces in zip(texts, batch.column(2), strict=True):
                words = text.as_py().split()
                found = _factors(pieces.as_py() or [], width)
                counts.append(len(words))
                if found:
                    keep = bytearray(b"\1") * len(words)
                    for f in found:
                        keep[f["start"] : f["start"] + f["n_words"]] = bytes(f["n_words"])
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
                factors.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, kind)],
                names=["doc_id", "n_words", "n_removed", "kept_text", "factors"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text, factors``.

    ``factors`` are the removed stretches with the earlier place each repeats; ``kept_text`` has the words
    that stay, joined by one space.
    """
    spark = docs.sparkSession
    anchor = max(1, min(ANCHOR_WORDS, width // 2))
    size, frequent, common = sampled(docs, text_col, width, anchor)
    tasks = max(shuffle_partitions(spark), -(-size // BLOCK_BYTES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.hash(text).alias("mark"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    keys = even_keys(tasks)
    entries = keyed.select("id", "mark", "text").mapInArrow(_entries(width, anchor, keys, frequent, common), "block int, message binary")
    pieces = entries.repartition(tasks, "block").groupBy("block").applyInArrow(_block(width, len(common)), PIECES)
    by_document = pieces.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n", "ref_id", "ref_start")).alias("pieces"))
    joined = keyed.join(by_document, ["id", "mark"], "left").select("doc_id", "text", "pieces")
    return joined.mapInArrow(_cut(width), _KEPT)
