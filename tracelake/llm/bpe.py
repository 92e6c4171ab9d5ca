"""BPE encoding and decoding with a public vocabulary of words and word ends.

A text is cut at the special tokens' strings, each stretch is normalized
(NFC, white space to one space, lower case letter by letter), split into
contractions, runs of letters, single digits and runs of other signs, and each
piece is merged by a priority queue over a linked list (``vocab.merge``).
Pieces repeat, so each task keeps the ids of those it has met, up to a bound.
Decoding joins the vocabulary strings of the ids by spaces, as the public
library does for a tokenizer that names no decoder.

Defined results: null or empty text has no tokens and decodes to the empty
string; nothing is truncated; rows that repeat are encoded alike; other columns
are neither read nor returned.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import append_arrow, bounded_batches, map_arrow
from tracelake.llm.vocab import SPACES, vocabulary

_SPACE = f"[{SPACES}]+"
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACES + r"\p{L}\p{N}]+"
_KEPT = 1 << 18


class WordBPE:
    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.space = re.compile(_SPACE)
        self.find = regex.compile(_PIECES).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def normalize(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # str.lower() looks at neighbours for a final sigma; letters alone don't.
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def encode(self, text: str) -> list[int]:
        vocab, known, out = self.vocab, self.known, []
        for part in vocab.special_pattern.split(text) if vocab.special_pattern else [text]:
            if part in vocab.special:
                out.append(vocab.special[part])
                continue
            for piece in self.find(self.normalize(part)):
                ids = known.get(piece)
                if ids is None:
                    if len(known) >= _KEPT:
                        known.clear()
                    ids = known[piece] = tuple(vocab.encode_word(piece.encode()))
                out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.vocab.strings.__getitem__, ids))


class _Task:
    """Made on the driver without the vocabulary, which each task reads itself."""

    def __init__(self, path: str) -> None:
        self.path = path

    def start(self) -> Callable[..., dict]:
        bpe = WordBPE(self.path)

        def run(doc_id: pa.Array, text: pa.Array) -> dict:
            ids = [bpe.encode(t) if t else [] for t in text.to_pylist()]
            return {"doc_id": doc_id, "ids": ids, "decoded": list(map(bpe.decode, ids))}

        return run


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with all its columns, and ids and decoded beside them."""
    bounded_batches(docs.sparkSession)
    return append_arrow(docs, ["doc_id", "text"], _Task(path), "ids array<int>, decoded string")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ids array<int>, decoded."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(docs, _Task(path), "doc_id long, ids array<int>, decoded string")
