"""Licence scans with a generalised suffix automaton.

One automaton holds every word sequence that occurs in a licence template or base phrase.  A document's
words are streamed through it; the *matching statistics* (for each word the longest template sequence
that ends there) are above one word only where neighbouring words stand side by side in a template, so
only those stretches are walked.  A base phrase ends at a word if its state is among the suffix links of
the current match.  Right-maximal matches of ``MIN_MATCH`` words or more are chained by dynamic programming,
in order in document and template with gaps up to ``MAX_GAP``, into covered spans; a template whose best
chain covers ``MIN_COVER`` of it adds its label.

Defined results: a null, empty or wordless text has no words, places or labels and score 0; rows are
judged one by one, so repeated rows repeat their results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .license_texts import BASE_PHRASES, TEMPLATES

MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.6
#: Lower-cases A-Z and blanks all other ASCII that isn't a letter or digit.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """All factors of several token sequences; ``ends`` has where the factors of a state end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((k, i + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, token: int, length: int) -> int:
        """A state for the factors of ``state`` by ``token`` up to ``length``."""
        old = self.next[state][token]
        if self.length[old] == length:
            return old
        copy = self._state(length, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while state >= 0 and self.next[state].get(token) == old:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # an earlier sequence has this factor
            return self._split(last, token, self.length[last] + 1)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token, self.length[state] + 1)
        return new

    def find(self, sequence: list[int]) -> int:
        state = 0
        for token in sequence:
            state = self.next[state][token]
        return state


def best_chain(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Words covered, first word and end of the chain that covers most words of a template.

    ``found`` are matches (word in document, word in template, length).  In a chain both places go forward
    by gaps of ``MAX_GAP`` at most, and words that overlap in either count once.  By dynamic programming over
    all matches: each is tried after every match that can precede it, so a passage that occurs at several
    places of a template is taken at the one that fits.
    """
    found = sorted(set(found))
    best: list[tuple[int, int]] = []  # words covered by the best chain that ends with a match; its first word
    furthest: list[int] = []  # the last end in the document up to each match
    top = (0, 0, 0)
    for j, (start, at, length) in enumerate(found):
        covered, first = length, start
        for i in range(j - 1, -1, -1):
            if furthest[i] < start - MAX_GAP:
                break
            before, before_at, n = found[i]
            overlap = max(0, before + n - start, before_at + n - at)
            if before < start and before_at < at and overlap < length and before + n >= start - MAX_GAP and before_at + n >= at - MAX_GAP and best[i][0] + length - overlap > covered:
                covered, first = best[i][0] + length - overlap, best[i][1]
        best.append((covered, first))
        furthest.append(max(start + length, furthest[-1] if furthest else 0))
        if covered > top[0]:
            top = (covered, first, start + length)
    return top


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.labels = list(templates)
        self.phrases = list(phrases.values())
        token: dict[bytes, int] = {}
        number = lambda text: [token.setdefault(w, len(token)) for w in words(text.encode())]
        texts = [number(t) for t in templates.values()]
        bases = [number(p) for p in phrases]
        self.sizes = [len(t) for t in texts]
        self.token = token
        self.automaton = SuffixAutomaton([*texts, *bases])
        self.adjacent = np.zeros((len(token) + 1, len(token) + 1), bool)  # the last row and column are other words
        for t in (*texts, *bases):
            self.adjacent[t[:-1], t[1:]] = True
        own = {self.automaton.find(b): (i, len(b)) for i, b in enumerate(bases)}
        self.spoken: list[tuple[tuple[int, int], ...]] = []
        for state in range(len(self.automaton.next)):
            found, at = [], state
            while at > 0:
                if at in own:
                    found.append(own[at])
                at = self.automaton.link[at]
            self.spoken.append(tuple(found))

    def _walk(self, tokens: list[int], offset: int, places: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        a, state, length = self.automaton, 0, 0
        for i, token in enumerate(tokens):
            before = (state, length)
            while state and token not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            if before[1] >= MIN_MATCH and length < before[1]:
                matches.append((offset + i, before[1], before[0]))
            state = a.next[state].get(token, 0)
            length = length + 1 if state else 0
            for phrase, size in self.spoken[state]:
                if size <= length:
                    places.append((offset + i + 1 - size, phrase))
        if length >= MIN_MATCH:
            matches.append((offset + len(tokens), length, state))

    def _spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Best chain of each template: label, first word, end and share of the template covered."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in matches:
            for k, template_end in self.automaton.ends[state]:
                if k < len(self.labels):
                    by_template.setdefault(k, []).append((end - length, template_end - length, length))
        out = []
        for k, found in by_template.items():
            covered, first, end = best_chain(found)
            out.append((self.labels[k], first, end, min(1.0, covered / self.sizes[k])))
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Number of words, places of base phrases (word, phrase), template spans."""
        found = words(text)
        if len(found) < 2:
            return len(found), [], []
        other, get = len(self.token), self.token.get
        tokens = np.array([get(w, other) for w in found], np.int32)
        pairs = self.adjacent[tokens[:-1], tokens[1:]]
        if not pairs.any():
            return len(found), [], []
        edges = np.flatnonzero(np.diff(np.concatenate([[False], pairs, [False]])))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        for a, b in edges.reshape(-1, 2).tolist():
            self._walk(tokens[a : b + 1].tolist(), a, places, matches)
        return len(found), places, self._spans(matches)


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(dict(templates), dict(phrases))


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())])
_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])


def _scan(templates: tuple, phrases: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases)
        for batch in batches:
            counts, places, spans = [], [], []
            for text in T.string_column(batch.column(1)).cast(pa.large_binary()):
                n, found, covered = scanner.scan(text.as_py())
                counts.append(n)
                places.append([{"word": w, "label": scanner.phrases[p]} for w, p in found])
                spans.append([dict(zip(("label", "first_word", "end_word", "coverage"), x, strict=True)) for x in covered])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "n_words", "places", "spans"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """One row per document: ``doc_id, n_words, places`` (of base phrases) and ``spans`` (of templates)."""
    schema = "doc_id long, n_words long, places array<struct<word:long,label:string>>, spans array<struct<label:string,first_word:long,end_word:long,coverage:double>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(tuple(templates.items()), tuple(phrases.items())), schema)
