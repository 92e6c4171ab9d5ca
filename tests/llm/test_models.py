"""Trained and approximate operators: accuracy, recall, and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import html_extract
from tracelake.llm.ann import Setting, ann, choose, probe_sets
from tracelake.llm.boosting import fit, threshold_at
from tracelake.llm.embedding_dedup import descend, embedding_dedup
from tracelake.llm.toxicity import CUT, toxicity, with_toxicity

VECTORS = "vec_id long, embedding array<float>, label int, vector string, key int, group int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "v", 1, 2) for i, v, y in rows], VECTORS)


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]


def clustered(n, seed, label=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    near = n // 3
    x[:near] = rng.normal(size=16) + 0.1 * rng.normal(size=(near, 16))
    x[near + 1] = x[near]
    return [(i, v, int(rng.integers(0, 3)) if label is None else label) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("block_rows", [16384, 60])
def test_embedding_dedup(spark, block_rows):
    rows = clustered(400, 0)
    rows += [(500, rows[0][1], None), (501, rows[0][1] * 2, rows[0][2]), (502, [1.0] * 8, rows[0][2]), (0, rows[0][1], rows[0][2])]
    x = [np.asarray(v, float) for _, v, _ in rows]
    linked = lambda a, b: rows[a][2] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt(x[a] @ x[a] * (x[b] @ x[b])) >= 0.93
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = np.zeros(len(rows), int)
    for a in range(len(rows)):
        for b in range(a):
            if linked(a, b):
                want[a] += 1
                want[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    expected = sorted((k, int(want[i]), least[find(i)], k == least[find(i)]) for i, (k, _, _) in enumerate(rows))
    expected += [(k, 0, k, True) for k, _, _ in ODD[:-1]]
    got = embedding_dedup(vectors(spark, rows + ODD), block_rows=block_rows).collect()
    assert sorted(tuple(r) for r in got if r.vec_id is not None) == sorted(expected)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert embedding_dedup(vectors(spark, rows).where("false")).count() == 0


def clumps(size, seed=0, dims=16):
    """Two dense groups whose members also link across."""
    rng = np.random.default_rng(seed)
    u, w = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
    centres = [u, 0.95 * u + np.sqrt(1 - 0.95**2) * w]
    return np.concatenate([c + 0.003 * rng.normal(size=(size, dims)) for c in centres]).astype(np.float32)


def exact_links(x):
    """n_links and the least place of the component, by brute force."""
    x = np.asarray(x, float)
    link = x @ x.T / np.sqrt(np.outer((x * x).sum(axis=1), (x * x).sum(axis=1))) >= 0.93
    root = np.arange(len(x))
    while True:
        low = np.where(link, root, len(x)).min(axis=1)
        if (low == root).all():
            return link.sum(axis=1) - 1, root
        root = low


def test_embedding_dedup_links_between_dense_clumps(spark):
    x = clumps(60)
    links, root = exact_links(x)
    assert set(links) == {119} and set(root) == {0}
    got = embedding_dedup(vectors(spark, [(i, v, 1) for i, v in enumerate(x)])).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (119, 0) for i in range(120)}


def check_exact(spark, x, **bounds):
    links, root = exact_links(x)
    got = embedding_dedup(vectors(spark, [(i, v, 1) for i, v in enumerate(x)]), **bounds).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (links[i], root[i]) for i in range(len(x))}


def test_embedding_dedup_dense_label_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=64) + 0.26 * rng.normal(size=(600, 64))).astype(np.float32)
    check_exact(spark, x, block_rows=50)


def test_embedding_dedup_few_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 128))
    x[2000:2200] = x[:200] + 0.36 * rng.normal(size=(200, 128))
    x[3600:] = x[3600] + 0.02 * rng.normal(size=(400, 128))
    check_exact(spark, x.astype(np.float32))


def test_descent_finds_the_nearest():
    x = np.random.default_rng(3).normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :12]
    found = descend(x).ids
    assert np.mean([len(set(a) & set(b)) / 12 for a, b in zip(true, found)]) > 0.95


def brute(rows, queries, k):
    good = [(i, np.asarray(v, float)) for i, v, _ in rows if v is not None and i is not None and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            d = sorted({(float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v)})
            seen, best = set(), []
            for s, i in d:
                if i not in seen:
                    seen.add(i)
                    best.append((i, s))
            out[q] = best[:k]
    return out


def test_ann_of_one_cell_is_whole_and_ties_go_to_the_smaller(spark):
    rows = clustered(150, 1) + [(200 + i, [1.0] * 16, 0) for i in range(14)] + ODD + [(300, [1.0] * 8, 0)]
    df = vectors(spark, rows)
    got = {}
    for r in ann(df, F.col("vec_id") % 50 == 0, setting=Setting(0, 1.0, 1, 1)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, {0, 50, 100, 200, 250, 300}, 10)
    want = {q: v for q, v in want.items() if v}
    hashed = {}
    for r in ann(df, F.col("vec_id") % 50 == 0).collect():
        hashed.setdefault(r.query_id, set()).add(r.vec_id)
    assert {q: len(v) for q, v in hashed.items()} == {q: len(v) for q, v in want.items()} and recall_of(hashed, want) >= 0.8
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q]))
    assert ann(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def recall_of(got, want):
    return np.mean([len(got.get(q, set()) & {i for i, _ in v}) / len(v) for q, v in want.items()])


def test_ann_recall_with_many_cells_and_blocks(spark, monkeypatch):
    from tracelake.llm import ann as module

    monkeypatch.setattr(module, "CELL_ROWS", 40)
    monkeypatch.setattr(module, "CELL_QUERIES", 3)
    rows = clustered(3000, 2)
    got = {}
    for r in ann(vectors(spark, rows), F.col("vec_id") % 60 == 0, group_rows=2000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, set(range(0, 3000, 60)), 10)
    assert recall_of(got, want) >= 0.9


def test_ann_lists_the_cells_of_a_query_by_group():
    import pyarrow as pa

    from tracelake.llm import ann as module

    rng = np.random.default_rng(8)
    ids, raw = pa.array([5, 3, 9]), pa.array([rng.normal(size=4 + 4 * (i == 1)).tobytes() for i in range(3)], pa.binary())
    setting = Setting(4, 1.0, 64, 8)
    one, lists = module._asked(setting)(ids, raw), module._listed(setting, 7)(ids, raw)
    assert len(lists["group"]) <= 3 * 7 and len(one["key"]) == 3 * 8 * 64
    got = sorted((i, k) for i, keys in zip(lists["id"], lists["keys"].to_pylist()) for k in keys)
    assert got == sorted(zip(one["id"], one["key"]))
    assert all((k >> 32) % 7 == g for g, keys in zip(lists["group"], lists["keys"].to_pylist()) for k in keys)


def test_ann_in_one_cell_is_exact(spark):
    rows = clustered(800, 5)
    found = ann(vectors(spark, rows), F.col("vec_id") % 50 == 0, setting=Setting(0, 1.0, 1, 1), group_rows=300).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, set(range(0, 800, 50)), 10)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}


def test_ann_with_one_common_vector(spark, monkeypatch):
    from tracelake.llm import ann as module

    monkeypatch.setattr(module, "CELL_ROWS", 30)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v, 0) for i, v in enumerate(x)]
    got = {}
    for r in ann(vectors(spark, rows), F.col("vec_id") % 30 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 900, 30):
        # All queries hold the common vector: the least ids of it, at distance 0.
        assert got[q] == [(i, 0.0) for i in [j for j in range(0, 900, 3) if j != q][:10]]


def test_probes_come_in_order_and_meet_fewer_rows_as_rows_grow():
    sets = probe_sets(6, 40)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets) == 40
    assert all(len({min(s, 11 - s) for s in steps}) == len(steps) for steps in sets)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(400, 32))
    shares = []
    for n in (2000, 20000):
        x = centers[rng.integers(0, 400, n)] + 0.4 * rng.normal(size=(n, 32))
        near = [x[np.argsort(((x - x[i]) ** 2).sum(1))[1:11]] for i in range(40)]
        setting = choose(x[:40], near, x[40:1040], n)
        met, true = np.zeros((40, n), bool), 0
        for t in range(setting.tables):
            cells, visits = setting.keys(x, t)[:, 0], setting.keys(x[100:140], t, setting.probes)
            for i, v in enumerate(visits):
                met[i] |= np.isin(cells, v)
        for i in range(40):
            true += met[i, np.argsort(((x - x[100 + i]) ** 2).sum(1))[1:11]].mean() / 40
        assert true >= 0.9
        shares.append(met.mean())
    assert shares[1] < 0.1 and shares[1] <= shares[0]


def test_ann_measures_queries_that_meet_few_rows(spark, monkeypatch):
    from tracelake.llm import ann as module

    monkeypatch.setattr(module, "EXACT_QUERIES", 7, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[::100] *= 30
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(0, x[0], 0)] * 12
    got = {}
    for r in ann(vectors(spark, rows), F.col("vec_id") % 100 == 0, group_rows=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows, set(range(0, 3000, 100)), 10)
    assert set(got) == set(want) and all([n for n, _ in v] == list(range(1, 11)) for v in got.values())
    recall = [len({i for _, i in got[q]} & {i for i, _ in v}) / 10 for q, v in want.items()]
    assert np.mean(recall) >= 0.9 and recall.count(1.0) >= 25


def test_toxicity_learns_and_leaves_the_clean(spark):
    rng = np.random.default_rng(0)
    words = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        own = list(rng.choice(words, rng.integers(5, 80)))
        bad = i % 5 == 0
        if bad:
            own.insert(int(rng.integers(0, len(own))), str(rng.choice(["vile", "nastyish", "nastyone"])))
        rows.append((i, " ".join(own), str(rng.choice(["en", "de"])), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (None, "w1 vile", "en", "s"), (3, rows[3][1], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("own"))
    table = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity(docs, table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= CUT) == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert {r.doc_id: r.toxic for r in out}[5001] is False
    again = with_toxicity(docs, table)
    assert again.columns == ["doc_id", "text", "lang", "source", "score", "toxic"]
    none = toxicity(docs, table.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity(docs.where("false"), table).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now please.</div>
<article><h1>A title &amp; more</h1><p><b>Bold start<br><p>First   paragraph with <a href=x>a link</a> and
text.</p><p>Second &lt;one&gt; caf&eacute;.</article><aside><p>Aside words here.</p></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I think that this is so.</p></div></section>
<form><label>Mail</label><input name=q><button>Go</button></form><footer>&copy; someone</footer>"""


def test_html_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<script>x</script>"), (1, "u", PAGE), (5, "u", "<b>" * 3000 + "deep"), (6, "u", "<p <q \"")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.html_extract(df).collect()}
    assert got[1] == "A title & more\nBold start\nFirst paragraph with a link and text.\nSecond <one> café."
    assert got[2] == got[3] == got[4] == ""
    assert html_extract.html_extract(df.where("false")).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    parents, depths, sort = np.array([-1, 0, 0, 1, 1]), np.array([0, 1, 1, 2, 2]), np.array([2, 1, 0, 1, 2])
    score, pair = rng.normal(size=5), rng.normal(size=(3, 2, 2))
    p, joint = html_extract.marginals(score, parents, sort, depths, pair)
    weight, total, edge = np.zeros(5), 0.0, np.zeros((5, 2, 2))
    for bits in range(32):
        y = [bits >> i & 1 for i in range(5)]
        w = np.exp(sum(s * v for s, v in zip(score, y)) + sum(pair[sort[i], y[parents[i]], y[i]] for i in range(1, 5)))
        total += w
        weight += w * np.array(y)
        for i in range(1, 5):
            edge[i, y[parents[i]], y[i]] += w
    assert np.allclose(p, weight / total) and np.allclose(joint[1:], edge[1:] / total)


def test_html_model_on_unseen_layouts():
    model = html_extract.model()
    writer = html_extract._Writer(77)
    trees, labels = zip(*(writer.labelled() for _ in range(120)))
    x, parents, sort, depths, _ = html_extract._forest(list(trees))
    p, _ = html_extract.marginals(x @ model.unary, parents, sort, depths, model.pair)
    assert ((p >= 0.5) == np.concatenate(labels)).mean() > 0.97


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x[:1500], y[:1500]).probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert threshold_at(np.array([0.9, 0.8, 0.7]), np.array([1, 1, 0]), 1.0) == 0.8 and threshold_at(np.array([0.9]), np.array([0]), 0.5) > 1


def around(rng, center, cosine, n):
    """Unit vectors at about one cosine to a unit vector."""
    away = rng.normal(size=(n, len(center)))
    away -= np.outer(away @ center, center)
    return cosine * center + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1)[:, None]


def test_embedding_dedup_of_one_label_in_many_blocks(spark):
    """A dense group, two clumps whose members pass across, sparse pairs, and rows
    that link with nothing: all in one label, cut into many blocks."""
    rng = np.random.default_rng(9)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(n, 64)))
    one, two = unit(2)
    other = around(rng, two, 0.955, 1)[0]
    pairs = unit(60)
    x = np.concatenate([around(rng, one, 0.99, 300), around(rng, two, 0.99, 40), around(rng, other, 0.99, 40), pairs, np.concatenate([around(rng, p, 0.935, 1) for p in pairs]), unit(400)])
    x = x[rng.permutation(len(x))].astype(np.float32)
    wide = x.astype(float)
    near = wide @ wide.T / np.outer(np.linalg.norm(wide, axis=1), np.linalg.norm(wide, axis=1)) >= 0.93
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    for block_rows in (200, 16384):
        got = {r.vec_id: r for r in embedding_dedup(vectors(spark, [(i, v, 0) for i, v in enumerate(x)]), block_rows=block_rows).collect()}
        count = np.array([got[i].n_links for i in range(len(x))])
        assert (count <= want).all() and count.sum() >= 0.99 * want.sum() and (count == want).mean() >= 0.99
        linked = [(i, j) for i, j in zip(*np.nonzero(near))]
        assert np.mean([got[i].component_id == got[j].component_id for i, j in linked]) >= 0.99


def test_toxicity_training_is_bounded(spark):
    """An id repeated often and very long texts reach the driver once or not at all."""
    from tracelake.llm import toxicity as module

    assert module.within(np.array([5, 50, 4, 2]), 10).tolist() == [True, False, True, False]
    seen = []
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("vile words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    more = spark.createDataFrame([(i, ("nice " if i % 2 else "vile ") * (400_000 if i == 4 else 20), "en") for i in range(3, 60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 1 - i % 2) for i in range(3, 60)], "doc_id long, toxic int")
    kept = module.fit
    module.fit = lambda texts, *rest: seen.append(texts) or kept(texts, *rest)
    try:
        assert module.fit_labels(docs.unionByName(more), labels, max_bytes=1_000_000) is not None
    finally:
        module.fit = kept
    held = [i for i in [1, *range(3, 60)] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(seen[0]) <= 58 - len(held) and sum(map(len, seen[0])) <= 1_000_000 and sum(t.startswith("vile words") for t in seen[0]) <= 1


def test_pooling_equals_a_plain_convolution():
    from tracelake.llm import toxicity as module

    rng = np.random.default_rng(3)
    table = rng.normal(size=(module._BUCKETS + 1, module._DIM)).astype(np.float32)
    table[module._BUCKETS] = 0
    filters = [rng.normal(size=(w, module._DIM, module._FILTERS)).astype(np.float32) for w in module._WIDTHS]
    bias = rng.normal(size=module._FILTERS * len(filters)).astype(np.float32)
    model = module.Classifier(table, filters, bias, np.ones(len(bias), np.float32), 0.0)
    texts = ["", "one", "one two", "three words here and some more of them"]
    got = model.pooled(*module._Reader(table).lay(texts))
    for row, text in zip(got, texts):
        vectors = [sum(table[b] for b in module._buckets(w)) for w in text.split()] + [np.zeros(module._DIM)] * 3
        plain = []
        for f in filters:
            # Windows that start at a word, and at the first blank after the last.
            responses = [sum(vectors[min(i + k, len(vectors) - 1)] @ f[k] for k in range(len(f))) for i in range(len(text.split()) + 1)]
            plain += np.max(responses, axis=0).tolist()
        assert np.allclose(row, np.maximum(np.array(plain) + bias, 0), atol=1e-4)
