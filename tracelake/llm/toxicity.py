"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its
first letters (3, 4 and 5).  Filters of several widths run over the words of
the whole text, each is max-pooled over the text, and a logistic unit scores
the pooled values.  One dimension of the embeddings starts from the shrunken
log-odds of each hash bucket among the training labels; everything is then
trained by Adam.  Logits are rescaled on rows left out of training, and a
threshold is calibrated for each language that has enough positives there; a
language is never an input of a score.

Training reads at most ``max_rows`` labelled documents (those least by a hash of
their id) of at most ``max_bytes`` together, in that order; a text that no longer
fits is left out, and of the texts of one id the least by hash is taken.  The
driver holds no more than that.  Scoring reads every row, the whole text.

Defined results: null or empty text is scored from no words (every pooled value
is zero); without labelled rows of both classes every score is 0; of several
labels of one id the greatest counts; rows that repeat score alike; a null id
is in no held-out part; other columns are neither read nor returned, ``lang``
apart, which names the threshold only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import append_arrow, bounded_batches, map_arrow

MAX_ROWS = 6000
MAX_BYTES = 48 << 20
CUT = 0.3
_BUCKETS = 1 << 16
_DIM = 8
_FILTERS = 8
_WIDTHS = (1, 2, 3)
_STARTS = (3, 4, 5)
_KEPT = 1 << 18
_find = re.compile(r"\w+").findall


def _buckets(word: str) -> list[int]:
    digest = xxhash.xxh32_intdigest
    parts = [word, *("^" + word[:n] for n in _STARTS if len(word) >= n)]
    return [digest(p.encode()) % _BUCKETS for p in parts] + [_BUCKETS] * (1 + len(_STARTS) - len(parts))


@dataclass
class Classifier:
    """Row ``_BUCKETS`` of the embeddings is zero and stands for nothing."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Max-pooled responses by text; ``words`` holds the word vectors of all
        texts, with three zero rows after each, ``starts`` where each starts."""
        parts = []
        last = np.r_[starts[1:], len(words)]
        for width, f in zip(_WIDTHS, self.filters):
            r = words @ f[0]
            for k in range(1, width):
                r[:-k] += words[k:] @ f[k]
            # Windows that begin in the last two rows would reach into the next text.
            r[last - 1] = r[last - 2] = 0
            parts.append(np.maximum.reduceat(r, starts))
        return np.maximum(np.concatenate(parts, axis=1) + self.bias, 0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.shift


class _Reader:
    """Word vectors of texts; keeps those of known words, up to a bound."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.rows: dict[str, int] = {}
        self.vectors = np.zeros((1 << 12, table.shape[1]), np.float32)

    def lay(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [_find(t.lower()) for t in texts]
        new = list({w for ws in lists for w in ws if w not in self.rows})
        if len(self.rows) + len(new) >= _KEPT:
            self.rows.clear()
            new = list({w for ws in lists for w in ws})
        if new:
            first = len(self.rows) + 1
            need = first + len(new)
            if need > len(self.vectors):
                grown = np.zeros((max(need, 2 * len(self.vectors)), self.vectors.shape[1]), np.float32)
                grown[:first] = self.vectors[:first]
                self.vectors = grown
            self.vectors[first:need] = self.table[np.array(list(map(_buckets, new)))].sum(axis=1)
            self.rows.update(zip(new, range(first, need)))
        get = self.rows.__getitem__
        starts, flat = [], []
        for ws in lists:
            starts.append(len(flat))
            flat += map(get, ws)
            flat += (0, 0, 0)
        return self.vectors[np.array(flat, np.int64)], np.array(starts, np.int64)


def train(texts: list[str], labels: np.ndarray, epochs: int = 4, rate: float = 0.02, seed: int = 7) -> Classifier:
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float32)
    # Each text as numbers of words, and the buckets of each distinct word once.
    place: dict[str, int] = {}
    spots = [np.fromiter((place.setdefault(w, len(place)) for w in _find(t.lower())), np.int32) for t in texts]
    buckets = np.fromiter((b for w in place for b in _buckets(w)), np.int32).reshape(-1, 1 + len(_STARTS))
    del place
    rest = float(y.mean())
    seen, toxic = np.zeros(_BUCKETS + 1), np.zeros(_BUCKETS + 1)
    for r, label in zip(spots, y):
        own = np.unique(buckets[r])
        seen[own] += 1
        toxic[own] += label
    p = (toxic + 10 * rest) / (seen + 10)
    table = rng.normal(0, 0.05, (_BUCKETS + 1, _DIM)).astype(np.float32)
    table[:, 0] = (np.log(p / (1 - p)) - np.log(rest / (1 - rest))) / 4
    table[_BUCKETS] = 0
    filters = [rng.normal(0, 0.1, (w, _DIM, _FILTERS)).astype(np.float32) for w in _WIDTHS]
    for f in filters:
        f[0, 0, :] += 1
    n_pooled = _FILTERS * len(_WIDTHS)
    bias = np.full(n_pooled, -0.5, np.float32)
    out = np.full(n_pooled, 4.0 / n_pooled, np.float32)
    model = Classifier(table, filters, bias, out, -3.0)
    dense = [*filters, bias, out, np.array([model.shift], np.float32)]
    first, second, turn = [np.zeros_like(d) for d in dense], [np.zeros_like(d) for d in dense], 0
    square = np.zeros(_BUCKETS + 1, np.float32)

    for epoch in range(epochs):
        for i, at in enumerate(rng.permutation(len(spots))):
            if i % 16 == 0:
                grads = [np.zeros_like(d) for d in dense]
                sparse: list[tuple[np.ndarray, np.ndarray]] = []
            rows = buckets[spots[at]]
            x = np.concatenate([table[rows].sum(axis=1), np.zeros((3, _DIM), np.float32)])
            best, values = [], []
            for width, f in zip(_WIDTHS, filters):
                r = x @ f[0]
                for k in range(1, width):
                    r[:-k] += x[k:] @ f[k]
                top = r.argmax(axis=0)
                best.append(top)
                values.append(r[top, np.arange(_FILTERS)])
            raw = np.concatenate(values) + bias
            act = np.maximum(raw, 0)
            z = float(act @ out + dense[-1][0])
            slope = 1 / (1 + np.exp(-z)) - y[at]
            grads[-1][0] += slope
            grads[-2] += slope * act
            back = slope * out * (raw > 0)
            grads[-3] += back
            for j, (width, f) in enumerate(zip(_WIDTHS, filters)):
                b = back[j * _FILTERS : (j + 1) * _FILTERS]
                for k in range(width):
                    place = np.minimum(best[j] + k, len(x) - 1)
                    grads[j][k] += x[place].T * b
                    real = place < len(rows)
                    if real.any():
                        sparse.append((rows[place[real]], (f[k] * b).T[real]))
            if i % 16 == 15 or i == len(spots) - 1:
                turn += 1
                for d, g, m, v in zip(dense, grads, first, second):
                    m += 0.1 * (g / 16 - m)
                    v += 0.001 * ((g / 16) ** 2 - v)
                    d -= rate * 0.25 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-4)
                if sparse:
                    own = np.concatenate([a.ravel() for a, _ in sparse])
                    push = np.concatenate([np.repeat(g, 1 + len(_STARTS), axis=0) for _, g in sparse]) / 16
                    np.add.at(square, own, (push**2).sum(axis=1))
                    np.subtract.at(table, own, rate * push / (np.sqrt(square[own]) + 1e-2)[:, None])
                    table[_BUCKETS] = 0
    model.shift = float(dense[-1][0])
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logits that fit left-out labels, by Newton's method
    with a pull towards (1, 0)."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (w - (1, 0))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    return (float(max(w[0], 0.05)), float(w[1]))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 (the middle of the gap it falls in)."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def score(model: Classifier | None, texts: list[str], reader: _Reader | None = None) -> np.ndarray:
    if model is None or not texts:
        return np.zeros(len(texts))
    reader = reader or _Reader(model.table)
    z = model.logits(model.pooled(*reader.lay(texts))).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -30, 30)))


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], left_out: np.ndarray) -> Classifier | None:
    """Trains on the rows that are not ``left_out``, calibrates on those that are."""
    if len(set(labels[~left_out])) < 2:
        return None
    model = train([t for t, o in zip(texts, left_out) if not o], labels[~left_out])
    own = np.flatnonzero(left_out)
    y = labels[own].astype(float)
    if len(set(y)) == 2:
        reader = _Reader(model.table)
        z = np.concatenate([model.logits(model.pooled(*reader.lay([texts[i] for i in own[k : k + 64]]))) for k in range(0, len(own), 64)])
        model.scale = _platt(z.astype(np.float64), y)
        p = score(model, [texts[i] for i in own])
        for lang in {langs[i] for i in own if langs[i] is not None}:
            of = np.array([langs[i] == lang for i in own])
            if y[of].sum() >= 20:
                model.thresholds[lang] = float(np.clip(_threshold(p[of], y[of]), 0.1, 0.9))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def within(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which of the sizes, taken in order, fit together into ``most``."""
    taken, room = np.zeros(len(sizes), bool), most
    for i, size in enumerate(sizes):
        if size <= room:
            taken[i], room = True, room - size
    return taken


def fit_labels(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Classifier | None:
    """Fit on at most ``max_rows`` rows of ``labels`` (doc_id, toxic) that are
    not held out, and ``max_bytes`` of text; a fifth of them calibrates."""
    mark = F.xxhash64("doc_id")
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(mark, "doc_id").limit(max_rows)
    )
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    # At most max_rows ids, so the broadcast is bounded.
    joined = docs.join(F.broadcast(chosen), "doc_id").withColumn("digest", F.xxhash64("text", "lang"))
    # Ids and digests alone are compared; then the texts that fit are fetched.
    least = joined.groupBy("doc_id").agg(F.min_by(F.octet_length("text"), F.col("digest")).alias("size"), F.min("digest").alias("digest"))
    plan = least.toPandas()
    plan["place"] = plan["doc_id"].map({i: n for n, i in enumerate(r.doc_id for r in chosen.select("doc_id").collect())})
    plan = plan.sort_values("place")
    plan = plan[within(plan["size"].to_numpy(), max_bytes)]
    if plan.empty:
        return None
    wanted = docs.sparkSession.createDataFrame(list(zip(plan["doc_id"].tolist(), plan["digest"].tolist())), "doc_id long, digest long")
    rows = (
        joined.join(F.broadcast(wanted), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
        .select("text", "lang", "toxic", (F.pmod(mark, F.lit(5)) == 0).alias("out"), mark.alias("m")).toPandas().sort_values(["m", "text"])
    )
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy(), rows["lang"].tolist(), rows["out"].to_numpy(bool))


class _Task:
    def __init__(self, model: Classifier | None) -> None:
        self.model = model

    def start(self) -> Callable[..., dict]:
        reader = _Reader(self.model.table) if self.model else None

        def run(doc_id: pa.Array, text: pa.Array, lang: pa.Array) -> dict:
            texts = [t or "" for t in text.to_pylist()]
            p = score(self.model, texts, reader)
            least = self.model.thresholds if self.model else {}
            return {"doc_id": doc_id, "score": p, "toxic": [bool(v >= least.get(x, CUT)) for v, x in zip(p, lang.to_pylist())]}

        return run


def with_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` with all its columns, and score and toxic beside them."""
    bounded_batches(docs.sparkSession)
    return append_arrow(docs, ["doc_id", "text", "lang"], _Task(fit_labels(docs, labels, max_rows)), "score double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): score, toxic (by the
    language's threshold)."""
    bounded_batches(docs.sparkSession)
    model = fit_labels(docs, labels, max_rows)
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), _Task(model), "doc_id long, score double, toxic boolean")
