"""Substring dedup: remove passages of words that occur anywhere else.

Seed and extend.  Words are hashed to 64 bits; the hashes of ``k`` consecutive
words are winnowed over the ``window - k + 1`` of them that a window of
``window`` words holds, so that equal windows always select the same seed at
the same offset.  Documents meet on the seeds that occur twice or more.  A seed
is then extended both ways to the *span* of all the windows that selected it:

* a span seen twice is repeated as a whole, with no further work;
* where occurrences of one seed have different spans, one representative of
  each distinct span is extended window by window, and the windows that two
  representatives (or two places) share are repeated.

Overlapping repeated windows of a document join to its maximal repeats.  No
pairs of occurrences are ever formed, so a passage with a million copies costs
a million rows, and equal copies are combined before they are shuffled.

Defined results: null text is an empty text; a text of fewer words than
``window`` has no window and loses nothing; rows that repeat (same id, same
text) are copies of each other like any others; a null ``doc_id`` is allowed;
other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, map_arrow, materialize

WINDOW = 35
SEED_WORDS = 8
#: Words that are hashed together, which bounds the arrays; a longer text goes alone.
WORDS = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 12)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        return self.up, self.down


class _Rolling:
    """Hashes of any run of words of one document, independent of its place."""

    def __init__(self, words: list[bytes], powers: _Powers) -> None:
        n = len(words)
        values = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(1)), np.uint64, n)
        self.up, down = powers.upto(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * down[:n], out=self.sums[1:])

    def of(self, lo, hi) -> np.ndarray:
        """Of words lo to hi - 1; the power of the base is that of the last word."""
        return _mix((self.sums[hi] - self.sums[lo]) * self.up[lo])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _together(texts: Iterable[str], window: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Places and words of the texts with a window, some ``WORDS`` words at a time."""
    places, found, n = [], [], 0
    for place, text in enumerate(texts):
        words = text.encode().split()
        if len(words) >= window:
            places.append(place)
            found.append(words)
            n += len(words)
            if n >= WORDS:
                yield places, found
                places, found, n = [], [], 0
    if found:
        yield places, found


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` values in a row is, the first of equals."""
    least, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least, have = np.minimum(least[step:], least[:-step]), have + step
    return at


def _seeds(window: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        width = window - k + 1
        for pdf in batches:
            all_k1, all_k2, out = pdf["k1"].to_numpy(), pdf["k2"].to_numpy(), []
            for places, found in _together(pdf["text"], window):
                # All texts are hashed in one row of words; the windows that
                # cross from one to the next are left out.
                size = np.fromiter(map(len, found), np.int64, len(found))
                begin = np.cumsum(size) - size
                roll = _Rolling(list(chain.from_iterable(found)), powers)
                at = np.arange(size.sum() - k + 1)
                grams = roll.of(at, at + k)
                chosen = _first_least(grams, width)
                last = np.zeros(len(chosen), bool)
                last[:-1] = chosen[1:] != chosen[:-1]
                own = np.ones(len(chosen), bool)
                for b in begin[1:]:
                    own[b - window + 1 : b] = False
                last[begin + size - window] = True
                ends = np.flatnonzero(last & own)
                doc = np.searchsorted(begin, ends, "right") - 1
                lo, hi, seed = np.empty_like(ends), ends, chosen[ends].astype(np.int64)
                lo[0], lo[1:] = 0, ends[:-1] + 1
                starts = np.append(True, doc[1:] != doc[:-1])
                lo[starts] = begin[doc[starts]]
                # The seed's place in the span is part of the span's identity.
                span = roll.of(lo, hi + window) + (seed - lo).astype(np.uint64)
                keys = grams[seed]
                # Repeated within the document: the first place stands for
                # all of them, the others are settled and meet nothing.
                same = _mix(keys) ^ span
                order = np.lexsort((same, doc))
                new = np.append(True, (same[order][1:] != same[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
                copies = np.zeros(len(ends), np.int64)
                copies[order[new]] = np.diff(np.append(np.flatnonzero(new), len(ends)))
                lo, hi, place = lo - begin[doc], hi - begin[doc], np.asarray(places)[doc]
                k1, k2, settled = all_k1[place], all_k2[place], copies == 0
                keys[settled] = _mix(span[settled] + lo[settled].astype(np.uint64) + k2[settled].view(np.uint64))
                out.append((k1, k2, keys.view(np.int64), span.view(np.int64), lo, hi, copies))
            if out:
                yield pd.DataFrame(dict(zip(("k1", "k2", "seed", "span", "lo", "hi", "copies"), map(np.concatenate, zip(*out)))))

    return run


def _windows(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for pdf in batches:
            out = []
            for text, k1, k2, spans in zip(pdf["text"], pdf["k1"], pdf["k2"], pdf["spans"]):
                roll = _Rolling(text.encode().split(), powers)
                for s in spans:
                    at = np.arange(s["lo"], s["hi"] + 1)
                    one = np.ones(len(at), np.int64)
                    out.append((one * k1, one * k2, one * s["seed"], roll.of(at, at + window).view(np.int64), at, one * s["copies"]))
            if out:
                yield pd.DataFrame(dict(zip(("k1", "k2", "seed", "win", "lo", "copies"), map(np.concatenate, zip(*out)))))

    return run


def _cut(window: int):
    def run(doc_id: pa.Array, text: pa.Array, spans: pa.Array) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "repeats": []}
        for t, found in zip(text.to_pylist(), spans.to_pylist()):
            words = t.encode().split()
            change = np.zeros(len(words) + 1, np.int64)
            for s in found or ():
                change[s["lo"]] += 1
                change[s["hi"] + window] -= 1
            covered = np.cumsum(change)[:-1] > 0
            kept = words if not covered.any() else [w for w, c in zip(words, covered) if not c]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False]))))
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_text"].append(b" ".join(kept).decode())
            out["repeats"].append(edges.reshape(-1, 2).tolist())
        return {"doc_id": doc_id, **out}

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_removed, kept_text
    and ``repeats``, the [start, end) word ranges of its maximal repeats."""
    bounded_batches(docs.sparkSession)
    # (k1, k2) is a row's key: the id, and a hash of the text whose last bit
    # tells a null id.  Both joins with the texts read the same three columns,
    # so the texts are exchanged once.
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(
        text.alias("text"),
        F.coalesce(doc_id, F.lit(0)).alias("k1"),
        F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 1), 1).bitwiseOR(doc_id.isNull().cast("long")).alias("k2"),
    )
    seeds = docs.mapInPandas(
        _seeds(window, seed_words), "k1 long, k2 long, seed long, span long, lo int, hi int, copies long"
    )
    again = materialize(
        seeds.where("copies > 0").groupBy("seed").agg(F.sum("copies").alias("n")).where("n > 1").select("seed", F.lit(True).alias("met"))
    )
    met = materialize(seeds.join(again, "seed", "left").where("met or copies = 0").drop("met"))
    settled = met.where("copies = 0").select("k1", "k2", "lo", "hi")
    met = met.where("copies > 0")

    spans = met.groupBy("seed", "span").agg(
        F.sum("copies").alias("copies"),
        *(F.first(c).alias(c) for c in ("k1", "k2", "lo", "hi")),
    )
    whole = met.join(spans.where("copies > 1").select("seed", "span"), ["seed", "span"], "left_semi").select("k1", "k2", "lo", "hi")

    several = spans.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    stand_ins = (
        spans.join(several, "seed", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("seed", "lo", "hi", F.least("copies", F.lit(2)).alias("copies"))).alias("spans"))
    )
    windows = docs.join(stand_ins, ["k1", "k2"]).mapInPandas(
        _windows(window), "k1 long, k2 long, seed long, win long, lo int, copies long"
    )
    shared = windows.groupBy("seed", "win").agg(F.sum("copies").alias("n")).where("n > 1").select("seed", "win")
    partly = windows.join(shared, ["seed", "win"], "left_semi").select("k1", "k2", "lo", F.col("lo").alias("hi"))

    repeated = (
        settled.unionByName(whole).unionByName(partly)
        .groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    )
    return map_arrow(
        docs.join(repeated, ["k1", "k2"], "left").select(
            F.when(F.col("k2").bitwiseAND(F.lit(1)) == 0, F.col("k1")).alias("doc_id"), "text", "spans"
        ),
        _cut(window),
        "doc_id long, n_words long, n_removed long, kept_text string, repeats array<array<int>>",
    )
