"""Token counts from a compiled finite-state transducer.

A BPE encoding with pieces ranked by score has one property that makes it finite-state: the last token of
a prefix is the one token that ends there and forms a valid pair with the last token before it.  A state
therefore keeps, for each suffix that can still grow into a piece, the trie node of that suffix, the last
token before it and the token count there relative to now.  A transition is annotated with the change in
the number of emitted tokens.  States are built on first use and kept, as in a lazy DFA.

Long texts are cut into chunks.  A chunk's *state map* takes a state at entry to the tokens added and the
state at exit.  It is made without knowing that state, by a run from the start state whose states are kept;
from any other state the chunk is run only up to where both runs are in one state, which is where the
chunk's text no longer depends on what precedes it: at the latest before a word mark after another
character, since no piece has one inside.  Maps compose associatively, so those of a text's chunks are
combined pairwise, as in a parallel prefix scan, and applied to the start state once.

Defined results: a null or empty text has no tokens; rows are counted one by one; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

MARK = "▁"
CHUNK_CHARS, CHUNKS_AT_ONCE = 1 << 16, 64
#: States of a chunk's own run that are kept; a run from another state that has not met them by then goes on to the end.
KEPT_STATES = 4096
#: Bounds of what a worker keeps; beyond them it starts afresh.  They change no count.
MAX_MOVES, MAX_UNITS = 600_000, 250_000
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_START = re.compile(f"(?<=[^{MARK}]){MARK}")


class StateMap:
    """Of a chunk: state at entry to (tokens added, state at exit)."""

    def __init__(self, machine: CountingTransducer, chunk: str):
        first = _START.search(chunk)
        self.machine, self.head = machine, chunk[: first.start()] if first else chunk
        moves, state, count = machine.moves, 0, 0
        self.states, self.counts = [], []
        for i, c in enumerate(self.head):
            if i < KEPT_STATES:
                self.states.append(state)
                self.counts.append(count)
            move = moves[state].get(c) or machine._move(state, c)
            state, count = move[0], count + move[1]
        self.total, self.end, self.rest, self.exit = count, state, 0, None
        if first:
            units = _UNIT.findall(chunk, first.start())
            count, self.exit = machine.run(units[-1])
            self.rest = sum(map(machine.units.__getitem__, units[:-1])) + count

    def __call__(self, entry: int) -> tuple[int, int]:
        moves, state, count = self.machine.moves, entry, 0
        for i, c in enumerate(self.head):
            if i < len(self.states) and state == self.states[i]:
                count, state = count + self.total - self.counts[i], self.end
                break
            move = moves[state].get(c) or self.machine._move(state, c)
            state, count = move[0], count + move[1]
        return count + self.rest, state if self.exit is None else self.exit


@dataclass
class Composed:
    """The map of two neighbouring stretches."""

    a: StateMap | Composed
    b: StateMap | Composed

    def __call__(self, entry: int) -> tuple[int, int]:
        n, state = self.a(entry)
        m, state = self.b(state)
        return n + m, state


def compose(maps: list[StateMap]) -> StateMap | Composed:
    """The map of neighbouring chunks, combined pairwise."""
    level: list = maps
    while len(level) > 1:
        level = [Composed(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class CountingTransducer:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has a word mark inside")
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[str | None] = [None]
        for piece in self.score:
            if len(piece) > 1 and self._merge(piece) == [piece]:
                node = 0
                for c in piece:
                    if c not in self.trie[node]:
                        self.trie[node][c] = len(self.trie)
                        self.trie.append({})
                        self.token_at.append(None)
                    node = self.trie[node][c]
                self.token_at[node] = piece
        self.units = _Units(self)
        self._reset()

    def _reset(self) -> None:
        start = ((0, None, 0),)
        self.states, self.number = [start], {start: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.n_moves = 0
        self.pairs: dict[tuple[str, str], bool] = {}

    def _merge(self, text: str) -> list[str]:
        """The merge procedure itself, for short texts: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best = max(((self.score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _valid(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (a, b) not in self.pairs:
            self.pairs[a, b] = self._merge(a + b) == [a, b]
        return self.pairs[a, b]

    def _move(self, state: int, c: str) -> tuple[int, int]:
        """Compile one transition: next state and change in tokens."""
        grown = [(self.trie[node].get(c), last, count) for node, last, count in self.states[state]]
        weight = 1 if c in self.score else len(c.encode())
        token, now = c, self.states[state][-1][2] + weight
        for node, last, count in grown:  # longest suffix first
            if node is not None and self.token_at[node] and self._valid(last, self.token_at[node]):
                token, now = self.token_at[node], count + 1
                break
        entries = (*((node, last, count - now) for node, last, count in grown if node is not None and self.trie[node]), (0, token, 0))
        if entries not in self.number:
            self.number[entries] = len(self.states)
            self.states.append(entries)
            self.moves.append({})
        self.moves[state][c] = out = (self.number[entries], now)
        self.n_moves += 1
        return out

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """Tokens added by ``text`` from a state, and the state after it."""
        moves, count = self.moves, 0
        for c in text:
            move = moves[state].get(c) or self._move(state, c)
            state = move[0]
            count += move[1]
        return count, state

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.units) > MAX_UNITS:
            self.units.age()
        if self.n_moves > MAX_MOVES:
            self._reset()
        if len(text) <= CHUNK_CHARS and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return sum(map(self.units.__getitem__, words))
        marked = MARK + text.replace(" ", MARK)
        total, state = 0, 0
        for i in range(0, len(marked), CHUNK_CHARS * CHUNKS_AT_ONCE):  # bounds what is kept of a text
            part = marked[i : i + CHUNK_CHARS * CHUNKS_AT_ONCE]
            n, state = compose([StateMap(self, part[k : k + CHUNK_CHARS]) for k in range(0, len(part), CHUNK_CHARS)])(state)
            total += n
        return total


class _Units(dict):
    """Token counts of what lies between two starts of the machine; a bare word stands for one with a mark."""

    def __init__(self, machine: CountingTransducer):
        super().__init__()
        self.machine = machine
        self.older: dict[str, int] = {}

    def age(self) -> None:
        """Make room: what was used since the last time is kept for once more."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, unit: str) -> int:
        n = self.older.get(unit)
        if n is None:
            n = self.machine.run(unit if unit[0] == MARK else MARK + unit)[0]
        if len(unit) <= 40:
            self[unit] = n
        return n


@lru_cache(maxsize=2)
def transducer(model_file: str) -> CountingTransducer:
    return CountingTransducer(model_file)


def _count(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            n = [machine.count(x.as_py()) for x in T.string_column(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(_count(model_file), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
