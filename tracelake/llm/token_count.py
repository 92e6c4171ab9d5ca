"""Token counts by a compiled finite-state transducer.

The tokenizer (pre-token pattern and byte-pair merges together) is compiled,
as far as texts need it, to a deterministic transducer over letters.  A
transition carries the change of the number of tokens: the sum of the changes
along a text's path is the token count of the text.

Merging as an automaton.  A sequence of tokens is the encoding of its string
exactly when each two neighbours are (the merge of their strings gives the two
back).  So every prefix of a word has one last token, and the state after a
prefix is, for each suffix of it that may still grow to a token: the node of
the token trie, the last token before the suffix, and the count before it.
These are finitely many, and reading a byte picks the one suffix whose token
fits what stands before it.

The pattern as an automaton.  States tell letters, digits, other signs, white
space and the contractions apart.  A run of white space keeps the count of the
run without its last sign, for that sign leaves the run when a word follows.

Chunks.  Long texts are cut into chunks.  After a sign that is not white space
and then one that is, the state is the same whatever it was before, so the map
of a chunk from states to (state, count) is its head up to there, the count
from there on, and its last state.  A head is kept as its pieces, so composing
maps copies no text.  The maps of ``SPAN`` chunks are composed by a prefix scan
in pairs, which gives the count after every chunk; then the state is known and
nothing but it is carried on, so a text needs the memory of one span however
long it is, and compiled tables are dropped between spans once they are large.

Defined results: null or empty text has no bytes and no tokens; the special
token's string counts as one token; nothing is truncated; rows that repeat
count alike; other columns are neither read nor returned.
"""

from __future__ import annotations

import gc
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, map_arrow
from tracelake.llm.vocab import SPACES, Vocabulary, byte_letters, merge, vocabulary

CHUNK = 1 << 16
SPAN = 16
_MOST = 1 << 20
_LONG_WORD = 64
_PATHS = 1 << 19
_ROOT = 0
_SHORT = frozenset("stmd")
_LONG = {"r": "e", "v": "e", "l": "l"}


class MergeAutomaton:
    """States of prefixes of a pre-token; ``step`` compiles a transition."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        for string, token in vocab.ids.items():
            node = _ROOT
            for b in (byte_of[c] for c in string):
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = nxt
            self.token[node] = token
        self.bytes_of = {t: bytes(byte_of[c] for c in s) for s, t in vocab.ids.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        start = ((_ROOT, -1, 0),)
        self.names = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def number(self, name: tuple) -> int:
        number = self.numbers.get(name)
        if number is None:
            number = self.numbers[name] = len(self.names)
            self.names.append(name)
        return number

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their strings together."""
        if len(self.fits) >= _MOST:
            self.fits.clear()
        fit = (left, right) not in self.vocab.merges
        if fit:
            ids = [self.vocab.byte_ids[b] for b in self.bytes_of[left] + self.bytes_of[right]]
            fit = merge(ids, self.vocab.merges) == [left, right]
        self.fits[left, right] = fit
        return fit

    def step(self, state: int, b: int) -> tuple[int, int]:
        """(next state, change of the count) on byte ``b``."""
        move = self.moves.get(state << 8 | b)
        if move is not None:
            return move
        child, token_of, fits = self.child, self.token, self.fits
        grown, last, gain = [], -1, 0
        for node, before, count in self.names[state]:
            nxt = child[node].get(b)
            if nxt is None:
                continue
            if last < 0 and (token := token_of[nxt]) is not None:
                fit = before < 0 or fits.get((before, token))
                if fit is None:
                    fit = self._fit(before, token)
                if fit:
                    last, gain = token, count + 1
            if child[nxt]:
                grown.append((nxt, before, count))
        if gain:
            grown = [(n, t, c - gain) for n, t, c in grown]
        grown.append((_ROOT, last, 0))
        number = self.number(tuple(grown))
        self.moves[state << 8 | b] = move = (number, gain)
        return move

    def run(self, state: int, word: bytes) -> tuple[int, int]:
        total = 0
        for b in word:
            state, gain = self.step(state, b)
            total += gain
        return state, total


@dataclass(frozen=True)
class ChunkMap:
    """The map of a stretch of text: the pieces of ``head`` are read from the state
    before it; with ``end`` None they are all of it, else ``count`` and ``end`` follow."""

    head: tuple[str, ...]
    count: int = 0
    end: int | None = None


class CountTransducer:
    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.merges = MergeAutomaton(self.vocab)
        self.sync = regex.compile(f"[^{SPACES}][{SPACES}]")
        self.spaces = frozenset(SPACES)
        self.kinds: dict[str, str] = {}
        self._forget()

    def _forget(self) -> None:
        self.merges.forget()
        #: A state's name: (kind, merge state, change that the last space made, the sign itself)
        self.names: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table: list[dict[str, tuple[int, int]]] = []
        self.paths: defaultdict[int, dict[str, tuple[int, int]]] = defaultdict(dict)
        self.n_paths = self.size = 0
        self.start = self._number(("start", 0, 0, ""))

    def _number(self, name: tuple) -> int:
        number = self.numbers.get(name)
        if number is None:
            number = self.numbers[name] = len(self.names)
            self.names.append(name)
            self.table.append({})
        return number

    def _kind(self, c: str) -> str:
        kind = self.kinds.get(c)
        if kind is None:
            group = {"L": "letter", "N": "digit"}.get(unicodedata.category(c)[0], "other")
            kind = self.kinds[c] = "space" if c in self.spaces else group
        return kind

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        kind, inner, drop, sign = self.names[state]
        new, raw, run = self._kind(c), c.encode(), self.merges.run
        if kind == new and new != "space":
            nxt, gain = run(inner, raw) if len(raw) > 1 else self.merges.step(inner, raw[0])
            return self._number((new, nxt, 0, "")), gain
        if new == "space":
            if kind == "space":
                nxt, gain = run(inner, raw)
            else:
                nxt, gain = run(0, raw)
            return self._number(("space", nxt, gain, c)), gain
        if kind == "quote" and c in _SHORT:
            _, whole = run(0, b"'" + raw)
            return self._number(("start", 0, 0, "")), whole - run(0, b"'")[1]
        if kind == "half" and c == _LONG[sign]:
            _, whole = run(0, b"'" + sign.encode() + raw)
            return self._number(("start", 0, 0, "")), whole - run(0, b"'")[1] - run(0, sign.encode())[1]
        if kind == "quote" and c in _LONG:
            nxt, gain = run(0, raw)
            return self._number(("half", nxt, 0, c)), gain
        same = {"half": "letter", "quote": "other"}.get(kind, kind)
        if same == new:
            nxt, gain = run(inner, raw)
            return self._number((new, nxt, 0, "")), gain
        if kind == "space":
            if sign == " ":
                nxt, gain = run(0, b" " + raw)
                return self._number((new, nxt, 0, "")), gain - drop
            apart = run(0, sign.encode())[1] - drop
        else:
            apart = 0
        nxt, gain = run(0, raw)
        return self._number(("quote" if c == "'" else new, nxt, 0, "")), gain + apart

    def read(self, state: int, text: str) -> tuple[int, int]:
        """(state, change of the count) over ``text`` from ``state``.

        Paths over a whole word and the blank after it are kept by the state
        they set out from, as one transition each."""
        words = text.split(" ")
        rest, total = words.pop(), 0
        known = self.paths[state]
        for word in words:
            if len(word) > _LONG_WORD:
                state, gain = self._walk(state, word + " ")
                total += gain
                known = self.paths[state]
                continue
            path = known.get(word)
            if path is None:
                path = known[word] = self._walk(state, word + " ")
                self.n_paths += 1
            total += path[1]
            if path[0] != state:
                state = path[0]
                known = self.paths[state]
        state, gain = self._walk(state, rest)
        return state, total + gain

    def _walk(self, state: int, text: str) -> tuple[int, int]:
        table, total = self.table, 0
        row = table[state]
        for c in text:
            try:
                state, gain = row[c]
            except KeyError:
                state, gain = row[c] = self._compile(state, c)
                self.size += 1
            row = table[state]
            total += gain
        return state, total

    def resume(self, state: int, pieces: tuple[str, ...]) -> tuple[int, int]:
        total = 0
        for piece in pieces:
            state, gain = self.read(state, piece)
            total += gain
        return state, total

    def renew(self, state: int) -> int:
        """The number of a state once all that was compiled has been dropped."""
        kind, inner, drop, sign = self.names[state]
        name = self.merges.names[inner]
        self._forget()
        return self._number((kind, self.merges.number(name), drop, sign))

    def chunk_map(self, text: str) -> ChunkMap:
        found = self.sync.search(text)
        if found is None:
            return ChunkMap((text,))
        c = found.group()[1]
        inner, gain = self.merges.run(0, c.encode())
        end, count = self.read(self._number(("space", inner, gain, c)), text[found.end() :])
        return ChunkMap((text[: found.end()],), count, end)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.end is None:
            return ChunkMap(a.head + b.head, b.count, b.end)
        end, count = self.resume(a.end, b.head)
        return ChunkMap(a.head, a.count + count + b.count, end if b.end is None else b.end)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: neighbours are composed in pairs, the pairs'
        scan is taken, and the places between are filled from it."""
        if len(maps) < 2:
            return maps
        halves = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(halves[i // 2] if i % 2 else self.compose(halves[i // 2 - 1], maps[i]))
        return out

    def _stretch(self, text: str, chunk: int) -> int:
        state, total = self.start, 0
        if len(text) <= chunk:
            return self.read(state, text)[1]
        for at in range(0, len(text), chunk * SPAN):
            span = text[at : at + chunk * SPAN]
            last = self.scan([self.chunk_map(span[i : i + chunk]) for i in range(0, len(span), chunk)])[-1]
            state, gain = self.resume(state, last.head)
            total += gain + last.count
            state = state if last.end is None else last.end
            if self._large():
                state = self.renew(state)
        return total

    def _large(self) -> bool:
        return self.size > _MOST or len(self.merges.moves) > 2 * _MOST

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if self._large():
            self._forget()
        elif self.n_paths > _PATHS:
            self.paths.clear()
            self.n_paths = 0
        total = 0
        for part in self.vocab.special_pattern.split(text) if self.vocab.special_pattern else [text]:
            total += 1 if part in self.vocab.special else self._stretch(part, chunk)
        return total


@lru_cache(maxsize=2)
def shared(path: str) -> CountTransducer:
    """The transducer of this process: what one task compiled serves the next."""
    return CountTransducer(path)


class _Task:
    def __init__(self, path: str) -> None:
        self.path = path

    def start(self) -> Callable[..., dict]:
        # The tables are many small tuples without cycles, which the collector
        # would go through again and again.
        gc.set_threshold(100_000, 50, 1000)
        transducer = shared(str(self.path))

        def run(doc_id: pa.Array, text: pa.Array) -> dict:
            texts = [t or "" for t in text.to_pylist()]
            return {"doc_id": doc_id, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": list(map(transducer.count, texts))}

        return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_tokens."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(docs, _Task(path), "doc_id long, n_bytes long, n_tokens long")
