"""Operators with exact results, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import mixing, pii
from tracelake.llm.bpe import WordBPE, encode_decode
from tracelake.llm.common import connected_components
from tracelake.llm.simhash_dedup import fingerprint, keep_one, simhash_dedup
from tracelake.llm.substring_dedup import substring_dedup
from tracelake.llm.token_count import CountTransducer, token_counts
from tracelake.llm.vocab import merge

DOCS = "doc_id long, text string, lang string, source string, fp int, k1 string, seed string, mix_weight string"


def documents(spark, rows):
    """With more columns whose names clash with those the operators use."""
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", "y", "z") for d, t in rows], DOCS)


def groups(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(2)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(60)], "none": [(3, 3), (3, 3)],
        "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)],
    }[shape]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    want = groups([(a, b) for a, b in pairs if a != b], nodes)
    assert set(got) == nodes
    assert len({(want[n], got[n]) for n in nodes}) == len(set(want.values())) == len(set(got.values()))


def passages(seed):
    rnd = random.Random(seed)
    base = [str(rnd.randint(0, 9)) for _ in range(60)]
    out = []
    for i in range(50):
        kind = rnd.choice(["same", "period", "mixed", "short", "pair"])
        if kind == "same":
            words = ["a"] * rnd.choice([34, 35, 36, 80])
        elif kind == "period":
            words = ["a", "b", "c"][: rnd.randint(2, 3)] * rnd.randint(10, 40)
        elif kind == "mixed":
            k = rnd.randint(0, 30)
            words = [str(rnd.randint(0, 99)) for _ in range(20)] + base[k : k + rnd.randint(20, 60)] + [str(rnd.randint(0, 99)) for _ in range(20)]
        elif kind == "short":
            words = [str(x) for x in range(rnd.randint(0, 40))]
        else:
            words = [rnd.choice(["x", "y"]) for _ in range(300)] + base
        out.append((rnd.choice([i, i, i, None]), rnd.choice([" ", "\n", " \t"]).join(words)))
    long = " ".join(str(rnd.randint(0, 10**6)) for _ in range(20000))
    return out + out[:5] + [(100, None), (101, ""), (None, None), (2**60, long), (2**60 + 1, long + " end")]


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup(spark, seed):
    rows = passages(seed)
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    want = collections.Counter()
    for d, w in split:
        covered = [0] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                covered[i : i + 35] = [1] * 35
        kept = [x for x, c in zip(w, covered) if not c]
        want[d, len(w), len(w) - len(kept), " ".join(kept)] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(documents(spark, rows)).collect())
    assert got == want
    assert substring_dedup(documents(spark, []).where("false")).count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("long_posting", [64, 1])
def test_simhash(spark, long_posting):
    rnd = random.Random(4)
    base = [str(rnd.randint(0, 500)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "ÄB c"), (5, "Äb C"), (6, "one"), (None, "one"), (None, "only null")]
    for i in range(60):
        w = base[:]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(400)] = str(rnd.randint(0, 500))
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(str(rnd.randint(0, 9**9)) for _ in range(30))) for i in range(30)] + rows[8:12]
    prints = [plain_fingerprint(t or "") for _, t in rows]
    assert prints == [fingerprint(t or "") for _, t in rows]
    distinct = sorted(set(prints))
    component = groups([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2], distinct)
    least = {}
    for (d, _), p in zip(rows, prints):
        least.setdefault(component[p], []).append(d)
    want = collections.Counter((d, f"{p:016x}", min((x for x in least[component[p]] if x is not None), default=None)) for (d, _), p in zip(rows, prints))
    docs = documents(spark, rows)
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(docs, long_posting=long_posting).collect())
    assert got == want
    kept = keep_one(docs, long_posting=long_posting)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len({component[p] for p in prints}) == len({component[plain_fingerprint(t or "")] for t in texts})
    assert simhash_dedup(docs.where("false")).count() == 0 == keep_one(docs.where("false")).count()


ODD = [
    "", "  ", "it's don't 'sound 'll we'Re 1234 ١٢ <|endoftext|> x<|startoftext|>y <|endoftext|", "ΑΣ ΣΑΣ İstanbul ǅ ß ﬁ é ẛ̣ 한국 日本語 😀👨‍👩 \x00\x01\x1c\x1d\x85\xa0​　 à",
    "a" * 3000, "!?" * 500, "x y᠎z", "-" * 300, " " * 200 + "x", "hello\n\n\n  world \t\tfoo",
]


def odd_texts(n):
    rnd = random.Random(1)
    pool = [*"aA'sStTreEvmld 1٣½Ⅷ\n\t éÉ中😀.,!-   \r\x0b", "<|endoftext|>"]
    return ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_merge_skips_stale_entries():
    merges = {(1, 1): (0, 2), (2, 1): (1, 3), (1, 2): (2, 4)}
    assert merge([1] * 5, merges) == [2, 3] and merge([1], merges) == [1] and merge([5, 6], merges) == [5, 6]


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), WordBPE(path)
    texts = odd_texts(1500)
    for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(t) == e.ids
        assert ours.decode(e.ids) == theirs.decode(e.ids, skip_special_tokens=False)
    got = {r.doc_id: (r.ids, r.decoded) for r in encode_decode(documents(spark, [(2**60 + 1, "Hello"), (2, None), (None, "")]), path).collect()}
    assert got[2] == ([], "") == got[None] and got[2**60 + 1][0] == theirs.encode("Hello", add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), CountTransducer(path)
    texts = odd_texts(2500)
    want = [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert list(map(ours.count, texts)) == want
    assert [ours.count(t, chunk=7) for t in texts] == want
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(documents(spark, [(1, "é é"), (2, None), (3, "")]), path).collect()}
    assert got == {1: (5, theirs.encode("é é").__len__()), 2: (0, 0), 3: (0, 0)}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = "".join(re.findall("[0-9]", m.group()))
            fine = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans():
    rnd = random.Random(5)
    pool = [*"a.@-+ 0123456789()%_é", "4111111111111111", "1.2.3.4", "256.1.1.1"]
    for _ in range(5000):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 60)))
        assert pii.base_spans(t) == plain_spans(t)
    for t in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "a@" * 100_000, "+1(" * 100_000):
        pii.base_spans(t)


def test_pii_operator(spark):
    rows = [(1, "mail ann (at) foo (dot) com or bob@x.org, call 555-123-4567"), (2, None), (3, ""), (4, "version 10.2 of 2024-01-02, é 1.2.3.4"), (4, "clean words only")]
    got = collections.defaultdict(list)
    for r in pii.pii(documents(spark, rows), redacted=True).collect():
        got[r.doc_id].append(r)
    assert [s.kind for s in got[1][0].spans] == ["email", "email", "phone"] and [s.base for s in got[1][0].spans] == [False, True, False]
    assert got[1][0].redacted == "mail [EMAIL] or [EMAIL], call [PHONE]"
    assert got[2][0].spans == [] == got[3][0].spans and [(s.start, s.end) for r in got[4] for s in r.spans] == [(30, 37)]


def test_pii_scores_held_out_examples():
    trees, least = pii.model()
    x, y = pii._examples(1500, 3)
    p = trees.probability(x)
    for i, kind in enumerate(pii.KINDS):
        own = x[:, i] == 1
        chosen = p[own] >= least[kind]
        assert y[own][chosen].mean() > 0.97 and chosen[y[own] == 1].mean() > 0.7


def test_mixing_reaches_its_targets(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 30)) + rnd.choice(["", " | ", " %%%%%%%%"]), rnd.choice("aab"), rnd.choice(["x", "x", "x", "y", None])) for i in range(3000)]
    rows += [(None, None, None, None), (1, "", "c", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit(1)).withColumn("topic", F.lit("t"))
    docs = docs.withColumn("__source", F.lit(1)).withColumn("__lang", F.lit(2)).withColumn("mix_key_0", F.lit(3)).withColumn("Mix_Key_1", F.lit(4))
    targets = {"source": {"x": 0.4, "y": 0.4, "unknown": 0.2, "absent": 5.0}, "lang": {"a": 0.5, "b": 0.5}}
    with pytest.raises(Exception):
        mixing.mix(docs.drop("lang"))
    topic = F.when(F.col("doc_id") % 3 == 0, "even").otherwise("odd")
    out = mixing.mix(docs, targets, topic=topic).cache()
    assert out.count() == len(rows) and out.columns == [*docs.columns, *mixing.ADDED]
    total = out.agg(F.sum(F.col("mix_tokens") * F.col("mix_weight"))).first()[0]
    for d, want in (("lang", {"a": 0.5, "b": 0.5}), ("source", {"x": 0.4, "y": 0.4, None: 0.2})):
        share = {r[0]: r[1] / total for r in out.groupBy(d).agg(F.sum(F.col("mix_tokens") * F.col("mix_weight"))).collect()}
        assert all(abs(share[k] - v) < 1e-4 for k, v in want.items())
    chosen = out.where("mix_selected").agg(F.sum("mix_tokens")).first()[0]
    assert abs(chosen / out.agg(F.sum(F.col("mix_tokens") * F.col("mix_probability"))).first()[0] - 1) < 0.15
    assert mixing.mix(docs.where("false")).count() == 0
    # Values that the targets do not name keep their share.
    some = mixing.mix(docs, {"source": {"x": 1.0}}, topic=topic).groupBy(F.coalesce("source", F.lit("unknown")).alias("s"))
    got = {r.s: (r.t, r.w) for r in some.agg(F.sum("mix_tokens").alias("t"), F.sum(F.col("mix_tokens") * F.col("mix_weight")).alias("w")).collect()}
    tokens = sum(t for t, _ in got.values())
    assert all(abs(w / tokens - t / tokens) < 1e-4 for t, w in got.values())


def test_topics_are_groups_of_words_that_stand_together(spark):
    rnd = random.Random(3)
    themes = [["harbour", "sailors", "anchors"], ["kitchen", "recipes", "baking"], ["orchard", "apples", "picking"]]
    rows = []
    for i in range(600):
        theme = themes[i % 3]
        noise = ["w" + str(rnd.randint(0, 50)) for _ in range(20)] + ["always"] * (i % 5 > 0)
        # The first word of a theme is the widest.
        rows.append((i, " ".join(noise + theme[:1] + [w for w in theme[1:] if rnd.random() < 0.7])))
    rows += [(900, None), (901, ""), (None, "nothing of it"), (3, rows[3][1])]
    docs = documents(spark, rows)
    topics = mixing.fit_topics(docs, topics=3, companions=2)
    assert set(topics) == {"en"} and sorted(map(sorted, topics["en"])) == sorted(map(sorted, themes))
    got = {r.doc_id: r.t for r in docs.select("doc_id", mixing.topic_of(F.col("text"), F.col("lang"), topics).alias("t")).collect()}
    of = {f"topic-{i + 1}": themes.index(next(t for t in themes if g[0] in t)) for i, g in enumerate(topics["en"])}
    assert all(of[got[i]] == i % 3 for i in range(600)) and got[900] == got[901] == got[None] == "other"
    assert mixing.fit_topics(docs.where("false")) == {} == mixing.fit_topics(docs.where("text = ''"))


def test_topics_are_fitted_on_all_documents(spark):
    import hashlib

    ids = sorted(range(2600), key=lambda i: hashlib.md5(f"topic:{i}".encode()).hexdigest())
    rows = [(i, "harbour\tsailors" if n % 2 else "harbours of", "en" if n < 2500 else "zz", "x") for n, i in enumerate(ids)]
    rows += [rows[-1]] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    topics = mixing.fit_topics(docs)
    assert set(topics) == {"en", "zz"}
    assert sorted(w[0] for w in topics["zz"]) == ["harbour", "harbours", "sailors"]
    got = {r.mix_topic for r in mixing.mix(docs).where("lang = 'zz'").select("mix_topic").collect()}
    assert got and "other" not in got


def test_companions_rarer_than_the_first_share_are_found(spark, monkeypatch):
    words = ["harbour", "sailors", "anchors", "kitchen", "recipes", "orchard", "picking", "gardens", "weather", "lantern"]
    rnd = random.Random(5)
    rows = [(i, " \n\t".join(w for k, w in enumerate(words) if rnd.random() < 0.45 / (1 + k / 2)) + " of\u2028 meadows\u2028") for i in range(400)]
    rows += [(500 + i, "harbour onlyonce \x0b onlytwo") for i in range(2)]
    docs = documents(spark, rows)
    split = {i: set(t.encode().split()) for i, t in rows}
    held = {w: {i for i, t in split.items() if w.encode() in t} for w in [*words, "onlyonce", "onlytwo"]}
    held = {w: d for w, d in held.items() if len(w) >= 6 and len(d) * 2 <= len(rows)}
    seeds = sorted(held, key=lambda w: (-len(held[w]), w))[:2]
    both = lambda s, w: len(held[s] & held[w])
    wanted = []
    for s in seeds:
        near = [w for w in held if w not in seeds and both(s, w) >= 2]
        wanted.append([s, *sorted(near, key=lambda w: (-(both(s, w) ** 2) / (len(held[w]) * len(held[s])), w))[:4]])
    for share in (2, 10, 1000):
        monkeypatch.setattr(mixing, "SHARE", share)
        assert mixing.fit_topics(docs, topics=2) == {"en": wanted}, share
    odd = [(1, " a  b\tc\r\n"), (2, "a b\u00a0c d"), (3, ""), (4, None), (5, "\x0b"), (6, "é ü\nñ"), (7, "one")]
    got = {r.doc_id: r.mix_tokens for r in mixing.measured(documents(spark, odd)).collect()}
    assert got == {i: len((t or "").encode().split()) for i, t in odd}


def test_seeds_of_texts_hashed_together_are_those_of_each_alone(monkeypatch):
    import pandas as pd

    from tracelake.llm import substring_dedup as module

    rnd = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    sizes = [0, 1, 34, 35, 36, 70, 300, 35, 2000, 90]
    texts = [" ".join(rnd.choices("abcdefgh", k=n)) + rnd.choice(["", f" {passage}", f" {passage} x {passage}"]) for n in sizes * 6]
    pdf = pd.DataFrame({"text": [*texts, texts[8], "a " * 500], "k1": range(62), "k2": [(-1) ** i * (i << 50) for i in range(62)]})
    found = {}
    for size in (1, 1 << 8, 1 << 15):
        monkeypatch.setattr(module, "WORDS", size)
        found[size] = pd.concat(module._seeds(35, 8)(iter([pdf[:30].reset_index(drop=True), pdf[30:].reset_index(drop=True)])), ignore_index=True)
    pd.testing.assert_frame_equal(found[1], found[1 << 15])
    pd.testing.assert_frame_equal(found[1], found[1 << 8])
    for k1, own in found[1].groupby("k1"):
        windows = len(pdf["text"][k1].split()) - 34
        assert own["lo"].tolist() == [0, *(own["hi"][:-1] + 1)] and own["hi"].iloc[-1] == windows - 1 and own["copies"].sum() == len(own)


def test_token_counts_of_long_unspaced_texts(spark, monkeypatch):
    from tracelake.llm import token_count as module

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), CountTransducer(path)
    rng = random.Random(4)
    letters = "abcdefgéß01"
    whole = "".join(rng.choices(letters, k=4000)) * 4000
    assert ours.count(whole) == ours.count(whole, chunk=1 << 22)
    # Tables are dropped between spans, in the middle of a word and of a run of blanks.
    monkeypatch.setattr(module, "_MOST", 500)
    monkeypatch.setattr(module, "SPAN", 3)
    for alphabet in (letters, letters + "    .'\n", "  \t\n"):
        text = "".join(rng.choices(alphabet, k=20000))
        assert ours.count(text, chunk=100) == len(theirs.encode(text, add_special_tokens=False).ids)


def test_coders_take_empty_tables_long_texts_and_repeats(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    long = "some words, again " * 60000
    docs = documents(spark, [(1, long), (1, long), (1, "x"), (2, "")])
    size = len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)
    assert sorted(r.n_tokens for r in token_counts(docs, path).collect()) == [0, 1, size, size]
    assert token_counts(docs.where("false"), path).count() == 0
    coded = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert coded.count() == 4 and coded.where("doc_id = 1").select("ids").distinct().count() == 2
    assert encode_decode(docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0
