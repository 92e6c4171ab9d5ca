"""Personal data: candidate spans scored by gradient-boosted trees.

Spans of the four base formats are always kept.  Beside them, wide generators
propose overlapping candidates of the same kinds (spelled-out addresses, phones
without a country prefix, addresses of sixteen-bit groups, shorter or oddly
separated card numbers).  Boosted trees score each candidate from its format
and the words around it; thresholds calibrated by kind on held-out examples
select the ones to redact, the highest score first where they overlap.

The trees are trained on examples that a seeded generator writes: personal data
in sentences, and look-alikes such as versions, dates, amounts, orders and
serial numbers.  No row of the tables is used in training.

All scans are linear in the length of the text.

Defined results: null or empty text has no spans; starts and ends count code
points, ends excluded; rows that repeat get the same spans; other columns are
neither read nor returned.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.boosting import Boosted, fit, threshold_at
from tracelake.llm.common import append_arrow, bounded_batches, map_arrow

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995
_SPANS = "spans array<struct<kind: string, start: int, end: int, base: boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append(("email", start, done))
        else:
            done = at + 1
        at = text.find("@", done)
    chains = [m for m in _CHAIN.finditer(text)]
    for m in chains:
        parts = m.group().split(".")
        place = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", place, end))
            place = end + 1
    if chains:
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Wide patterns by kind; each is bounded, so a scan stays linear.
_WIDE = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?(?:@|[(\[{] ?at ?[)\]}]) ?[\w-]{1,63}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[\w-]{2,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}(?![\w:])", re.I)),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[ .-]?[0-9]){12,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![\w-])")),
)
_HINTS = (
    ("mail", "contact", "write"),
    ("ip", "host", "server", "address", "ping", "login"),
    ("card", "visa", "credit", "payment", "mastercard", "amex", "paid"),
    ("phone", "tel", "call", "fax", "mobile", "dial", "reach"),
    ("order", "invoice", "serial", "isbn", "sku", "ref", "part", "id", "no"),
    ("version", "release", "build", "chapter", "section", "table", "figure", "score", "date", "page"),
)
_WORDS = re.compile(r"[a-z]+")


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern in _WIDE for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    before = _WORDS.findall(text[max(0, start - 40) : start].lower())[-5:]
    after = _WORDS.findall(text[end : end + 20].lower())[:2]
    x = [float(kind == k) for k in KINDS]
    x += [len(span), len(digits), len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0]
    x += [span.count(c) for c in " .-()/:@"]
    x += [float(bool(digits) and luhn(digits)), float(len(set(digits))), float(digits[:2].isdigit() and 34 <= int(digits[:2] or 0) <= 65)]
    x += [float("at" in span.lower()), float("dot" in span.lower()), float(span[-3:].isalpha()), float(any("a" <= c <= "f" for c in span.lower()))]
    x += [float(start > 0 and text[start - 1] in "#$€£"), float(end < len(text) and text[end] in "%€$°")]
    x += [float(any(w in hint for w in before)) for hint in _HINTS]
    x += [float(any(w in hint for w in after)) for hint in _HINTS[:4]]
    return x


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _with_check(rng: random.Random, n: int) -> str:
    head = rng.choice("3456") + _number(rng, n - 2)
    return next(head + c for c in "0123456789" if luhn(head + c))


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates with their truth, from sentences that a seeded writer makes."""
    rng = random.Random(seed)
    fill = ["the", "of", "and", "then", "ding", "was", "is", "la", "der", "une", "para", "on"]
    syllables = ["an", "re", "th", "lo", "mi", "ka", "es", "un", "der"]

    def name() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(2, 3)))

    def grouped(digits: str, sizes: list[int], sep: str) -> str:
        out, i = [], 0
        for k in sizes:
            out.append(digits[i : i + k])
            i += k
        return sep.join(out)

    def phone() -> str:
        sep = rng.choice(" .-")
        area = _number(rng, 3)
        return rng.choice([f"({area}){rng.choice([' ', '-'])}", area + sep, "00" + _number(rng, 2) + sep + area + sep]) + _number(rng, 3) + sep + _number(rng, 4)

    good = [
        ("email", lambda: f"{name()}{rng.choice(['(at)', '[at]', ' [at] ', ' (at) '])}{name()}{rng.choice(['(dot)', '[dot]', '.', ' [dot] '])}{rng.choice(['com', 'org', 'net', 'de'])}"),
        ("ip", lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8))),
        ("card", lambda: grouped(_with_check(rng, 15), [4, 6, 5], rng.choice(" .-"))),
        ("card", lambda: grouped(_with_check(rng, 16), [4, 4, 4, 4], ".")),
        ("phone", phone),
    ]
    bad = [
        lambda: grouped(_number(rng, 8), [4, 2, 2], rng.choice("-./")),
        lambda: grouped(_number(rng, 8), [2, 2, 4], rng.choice("-./ ")),
        lambda: grouped(_number(rng, 9), [3, 3, 3], rng.choice(". ")),
        lambda: grouped(_number(rng, 13), [3, 1, 4, 4, 1], "-"),
        lambda: _number(rng, rng.randint(13, 19)),
        lambda: grouped(_number(rng, 16), [4, 4, 4, 4], rng.choice(". -")),
        lambda: ":".join(_number(rng, 2) for _ in range(rng.randint(4, 6))),
        lambda: ".".join(_number(rng, rng.randint(1, 3)) for _ in range(rng.randint(3, 6))),
        lambda: " ".join(_number(rng, rng.randint(1, 4)) for _ in range(rng.randint(3, 7))),
        lambda: f"{rng.choice(fill)} (at) {rng.choice(fill)} . {rng.choice(fill)}",
        lambda: f"{rng.choice(fill)} @ {rng.choice(fill)}.{rng.choice(fill)}",
    ]
    own = dict(zip(KINDS, _HINTS))
    xs, ys = [], []
    while len(ys) < n:
        positive = rng.random() < 0.5
        if positive:
            kind, make = rng.choice(good)
            hint = rng.choice(own[kind]) if rng.random() < 0.7 else rng.choice(fill)
            # Bare national numbers are taken as phones only where words say so.
            if kind == "phone" and hint in fill:
                positive = False
            body = make()
        else:
            kind, body = "", rng.choice(bad)()
            hint = rng.choice(rng.choice(_HINTS[4:])) if rng.random() < 0.4 else rng.choice(fill)
        left = " ".join(rng.choice(fill) for _ in range(4))
        text = f"{left} {hint}{rng.choice([' ', ': ', ' # ' if not positive else ' '])}{body}{rng.choice([' ', ', ', '. '])}{rng.choice(fill)}"
        place = text.index(body, len(left))
        for k, a, b in candidates(text):
            xs.append(features(text, k, a, b))
            ys.append(float(positive and k == kind and a <= place + 1 and b >= place + len(body)))
    return np.array(xs), np.array(ys)


@lru_cache(maxsize=1)
def model(examples: int = 4000, precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """The trees, and by kind the least probability that selects a candidate."""
    trees = fit(*_examples(examples, 1))
    x, y = _examples(examples, 2)
    p = trees.probability(x)
    return trees, {k: max(0.5, threshold_at(p[x[:, i] == 1], y[x[:, i] == 1], precision)) for i, k in enumerate(KINDS)}


def added_spans(text: str, base: list[tuple[str, int, int]], trees: Boosted, least: dict[str, float]) -> list[tuple[str, int, int]]:
    found = candidates(text)
    if not found:
        return []
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    found = [c for c in found if not any(taken[c[1] : c[2]])]
    if not found:
        return []
    p = trees.probability(np.array([features(text, *c) for c in found]))
    out: list[tuple[str, int, int]] = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i])):
        kind, a, b = found[i]
        if p[i] >= least[kind] and not any(taken[a:b]):
            out.append(found[i])
            taken[a:b] = b"\1" * (b - a)
    return out


def find_spans(text: str, trees: Boosted, least: dict[str, float]) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start."""
    if not text or not _ANY.search(text):
        return []
    base = base_spans(text)
    spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, trees, least)]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each stretch that spans cover becomes the name of its first span's kind."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


class _Task:
    def __init__(self, redacted: bool) -> None:
        self.redacted = redacted
        self.trees, self.least = model()

    def __call__(self, doc_id: pa.Array, text: pa.Array) -> dict:
        texts = [t or "" for t in text.to_pylist()]
        spans = [find_spans(t, self.trees, self.least) for t in texts]
        out = {"doc_id": doc_id, "spans": [[dict(zip(("kind", "start", "end", "base"), s)) for s in found] for found in spans]}
        if self.redacted:
            out["redacted"] = [redact(t, s) if s else t for t, s in zip(texts, spans)]
        return out


def with_redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, and spans and redacted beside them."""
    bounded_batches(docs.sparkSession)
    return append_arrow(docs, ["doc_id", "text"], _Task(True), f"{_SPANS}, redacted string")


def pii(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its spans, and the text with
    them replaced if ``redacted``."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id long, {_SPANS}" + ", redacted string" * redacted
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _Task(redacted), schema)
