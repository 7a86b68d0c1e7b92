"""Quality rules by weak supervision.

Each rule votes good or bad on a document or abstains.  Rules that look at the same thing are a group; a
group votes on one hidden fact, whether the document has the group's defect, and the rules of a group are
independent given that fact.  Expectation-maximisation estimates without labels how often the defect
occurs and how accurate each rule is on documents with and without it.  A document is good if it has no
defect; the posterior probability of that, the product of the groups', decides, not an all-must-pass filter.

The votes of a document form one of ``3 ** 8`` patterns, so the corpus is summed up exactly by at most that
many counts.  Rows are never shuffled.  A rule alone in its group cannot be told from its expectation by
the data: its accuracies stay near what is stated below, and only the share is learnt.

Defined results: a null text is an empty one; a document on which every rule abstains has the prior as its
posterior; an empty table gives an empty result; all other columns pass through unchanged but for one
named like ``out``, which is replaced by the operator's struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..storage import materialise
from . import textops as T

REPEAT_WINDOW = 5
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_bangs", "n_stops")
#: Rules that look at the same thing and so tend to fail together, by the defect they vote on.
GROUPS = {"characters": ("symbols",), "spam": ("duplicate_lines", "shouting", "repetition", "exclamation"), "writing": ("digits", "word_length", "sentences")}
#: What is expected before anything is seen: the share of a defect, and how often a rule that votes says bad
#: with the defect present and without.
START_SHARE, START_HIT, START_ALARM = 0.05, 0.9, 0.005
#: Weight of these expectations, as a share of the documents, and that of ``START_HIT`` as a part of it.
ANCHOR, HIT_WEIGHT = 0.02, 0.1


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = _flags(bytes(range(48, 58)))
_BANG = _flags(b"!?")
_STOP = _flags(b".;:")


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does an earlier one equal it; does any other."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    earlier, any_other = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order[1:]] = same
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    return earlier, any_other


def signals(part: T.Slice) -> np.ndarray:
    """The ``SIGNALS`` of each document of a slice, one row each."""
    data, offsets, n = part.data, part.offsets, part.n
    starts, ends, first_word = T.words(part)
    inside = ~T.IS_SPACE[data]
    hashes = T.word_hashes(data, starts, ends)

    newline = data == 0x0A
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(newline) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    breaks = np.append(np.flatnonzero(newline), len(data))
    line_ends = np.minimum(breaks[np.searchsorted(breaks, line_starts)], offsets[np.minimum(np.searchsorted(offsets, line_starts, "right"), n)])
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    lines = T.mix(T.word_hashes(data, line_starts, line_ends) ^ T.mix(line_doc.astype(np.uint64)))
    repeats = _repeated(lines)[0] if len(lines) else np.zeros(0, bool)

    at, document = T.window_documents(first_word, REPEAT_WINDOW)
    windows = T.mix(T.window_hashes(hashes, REPEAT_WINDOW)[at] ^ T.mix(document.astype(np.uint64))) if len(at) else np.zeros(0, np.uint64)
    twice = at[_repeated(windows)[1]] if len(at) else at
    in_repeat = T.covered(twice, REPEAT_WINDOW, len(starts))

    return np.column_stack([
        np.diff(first_word),
        _count(inside & ((data & 0xC0) != 0x80), offsets),
        _count(_SYMBOL[data], offsets),
        np.bincount(line_doc, minlength=n),
        np.bincount(line_doc[repeats], minlength=n),
        np.diff(np.concatenate([[0], np.cumsum(in_repeat)])[first_word]),
        *(_count(x[data], offsets) for x in (_UPPER, _LETTER, _DIGIT, _BANG, _STOP)),
    ]).astype(np.int64)


_STRUCT = pa.struct([(x, pa.int64()) for x in SIGNALS])


def _attach(text_at: int, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [signals(part) for part in T.slices(batch.column(text_at))]
            values = np.concatenate(rows) if rows else np.zeros((0, len(SIGNALS)), np.int64)
            struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(SIGNALS))], fields=list(_STRUCT))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=schema)

    return run


def with_signals(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with its signals in the struct column ``out``."""
    kind = S.StructType([S.StructField(x, S.LongType(), False) for x in SIGNALS])
    names = [*docs.columns, out]
    return docs.mapInArrow(_attach(docs.columns.index(text_col), names), S.StructType([*docs.schema.fields, S.StructField(out, kind)]))


def rules(s: Column) -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    per = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "symbols": vote(per("n_symbols", "word_chars") > 0.05, per("n_symbols", "word_chars") < 0.01),
        "duplicate_lines": vote((s["n_dup_lines"] >= 2) & (per("n_dup_lines", "n_lines") > 0.25), (s["n_lines"] >= 3) & (s["n_dup_lines"] == 0)),
        "word_length": vote((per("word_chars", "n_words") < 2.5) | (per("word_chars", "n_words") > 12), per("word_chars", "n_words").between(3.5, 9)),
        "shouting": vote((s["n_letters"] >= 20) & (per("n_upper", "n_letters") > 0.3), (s["n_letters"] >= 20) & (per("n_upper", "n_letters") < 0.12)),
        "repetition": vote(per("n_repeat_words", "n_words") > 0.1, (s["n_words"] >= 20) & (s["n_repeat_words"] == 0)),
        "exclamation": vote((s["n_words"] >= 10) & (per("n_bangs", "n_words") > 0.2), per("n_bangs", "n_words") < 0.02),
        "digits": vote(per("n_digits", "word_chars") > 0.3, per("n_digits", "word_chars") < 0.1),
        "sentences": vote((s["n_words"] >= 30) & (per("n_stops", "n_words") < 0.005), (s["n_words"] >= 10) & per("n_stops", "n_words").between(0.02, 0.5)),
    }


def group_number(s: Column, group: tuple[str, ...]) -> Column:
    """The votes of a group as one number below ``3 ** len(group)``."""
    votes, out = rules(s), F.lit(0)
    for name in group:
        out = out * 3 + (votes[name] + 1)
    return out.cast("int")


def _votes(n_rules: int) -> np.ndarray:
    """All patterns of votes in the order of their numbers, one row each."""
    return np.arange(3**n_rules)[:, None] // 3 ** np.arange(n_rules - 1, -1, -1)[None, :] % 3 - 1


def fit_group(counts: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, dict]:
    """Expectation-maximisation over the counts of a group's ``3 ** n`` patterns.

    Returns the probability that a document with each pattern is free of the group's defect, and the model:
    the defect's share, and for each rule how often it says bad, when it votes, of documents with the defect
    (``hit``) and without (``alarm``).  ``hit`` is held at twice ``alarm`` or more, so a vote that turns from
    good to none or from none to bad never raises the probability.
    """
    n = round(np.log(len(counts)) / np.log(3))
    votes = _votes(n)
    bad, good = (votes == -1).astype(float), (votes == 1).astype(float)
    total, cast = counts.sum(), bad + good
    weight = ANCHOR * total + 1
    share, hit, alarm = START_SHARE, np.full(n, START_HIT), np.full(n, START_ALARM)
    free = np.full(len(counts), 1 - share)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + bad @ np.log(hit / alarm) + good @ np.log((1 - hit) / (1 - alarm))
        before, free = free, 1 / (1 + np.exp(odds))
        if np.abs(free - before).max() < 1e-12:
            break
        clean = counts * free
        spoilt = counts - clean
        share = (spoilt.sum() + weight * START_SHARE) / (total + weight)
        alarm = np.clip((clean @ bad + weight * START_ALARM) / (clean @ cast + weight), 1e-5, 0.3)
        hit = np.clip(np.maximum((spoilt @ bad + weight * HIT_WEIGHT * START_HIT) / (spoilt @ cast + weight * HIT_WEIGHT), 2 * alarm), 0.05, 1 - 1e-5)
    return free, {"share": float(share), "hit": hit.tolist(), "alarm": alarm.tolist()}


def fit(counts: dict[tuple[int, ...], int]) -> dict[str, tuple[np.ndarray, dict]]:
    """The fitted groups, from documents counted by their groups' numbers in the order of ``GROUPS``."""
    out = {}
    for g, (name, group) in enumerate(GROUPS.items()):
        own = np.zeros(3 ** len(group))
        for key, n in counts.items():
            own[key[g]] += n
        out[name] = fit_group(own)
    return out


def judge(rows: DataFrame, out: str, keep_at: float = 0.5) -> DataFrame:
    """``rows``, which have their signals in the struct ``out``, with posterior and verdict added to it.

    ``rows`` are read twice; at most ``3 ** 8`` counts of patterns reach the driver, whatever their number.
    """
    s = F.col(out)
    numbers = [group_number(s, group) for group in GROUPS.values()]
    found = rows.groupBy(*(n.alias(f"g{i}") for i, n in enumerate(numbers))).agg(F.count(F.lit(1)).alias("n")).collect()
    model = fit({tuple(r[:-1]): r[-1] for r in found})
    posterior = F.lit(1.0)
    for number, (free, _) in zip(numbers, model.values(), strict=True):
        posterior = posterior * F.element_at(F.array(*(F.lit(float(x)) for x in free)), number + 1)
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    kept = ~failed & (posterior >= keep_at)
    full = F.struct(*(s[x].alias(x) for x in SIGNALS), posterior.alias("posterior"), failed.alias("base_failed"), kept.alias("kept"))
    return rows.withColumn(out, full)


def quality_rules(docs: DataFrame, text_col: str = "text", out: str = "quality_rules", keep_at: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct ``out``: the signals, ``posterior``, ``base_failed`` and ``kept``.

    Signals are computed once and written to the shared folder with the rows, without the text unless
    ``keep_text``; counting and judging read them there.  A column named like ``out`` is replaced.
    """
    docs = docs.drop(out) if out != text_col else docs
    rows = with_signals(docs, text_col, out)
    return judge(materialise(rows if keep_text else rows.drop(text_col), "quality"), out, keep_at)
