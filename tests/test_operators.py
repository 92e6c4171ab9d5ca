import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import columns as c
from tracelake.operators import align, catalog, decode, framing, islands, metrics, registry, select, tidy, trials


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_nearest_ties_and_range(spark):
    frames = spark.createDataFrame([(1, 0), (1, 10), (1, 20)], "job long, frame long")
    events = spark.createDataFrame([(1, -1), (1, 0), (1, 5), (1, 16), (1, 20), (1, 21), (2, 5)], "job long, ts long")
    got = {r.ts: r.frame_ts for r in align.nearest(events.where("job = 1"), frames, "job", "ts", "frame").collect()}
    assert got == {-1: None, 0: 0, 5: 0, 16: 20, 20: 20, 21: None}
    assert rows(align.nearest(events.where("job = 2"), frames, "job", "ts", "frame"), "ts", "frame_ts") == [(5, None)]
    assert rows(align.nearest_frames(events, frames, "job", "ts", "frame"), "frame") == [(0,), (20,)]
    assert {r.ts: r.idx for r in align.left_rank(events.where("job = 1"), frames, "job", "ts", "frame").collect()} == {-1: 0, 0: 0, 5: 1, 16: 2, 20: 2, 21: 3}


@pytest.mark.parametrize("step", [3, 7, 100])
def test_intervals_share_their_ends(spark, step):
    frames = spark.createDataFrame([(1, t) for t in range(0, 31, 5)], "job long, t long")
    trials_ = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 10, 20)], "job long, trial long, a long, b long")
    assert rows(align.in_intervals(frames, trials_, "job", "t", "a", "b", step), "t", "trial") == [(5, 1), (10, 1), (10, 2), (15, 2), (20, 2)]
    assert rows(align.outside_intervals(frames, trials_, "job", "t", "a", "b"), "t") == [(0,), (25,), (30,)]


def test_expand_and_clock(spark):
    df = spark.createDataFrame([(0, 3), (5, 5)], "a long, b long")
    assert rows(align.expand(df, "a", "b"), "idx") == [(0,), (1,), (2,)]
    k = spark.createDataFrame([(1, 5.0, None), (1, 9.0, None)], "job long, t double, off double")
    assert rows(align.clock_range(k, "job", "t", "off"), "first_sample", "last_sample") == [(None, None)]


def test_islands(spark):
    v = [0, 1, 1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "job long, i long, x int")
    found = islands.runs(df, "job", "i", F.col("x") > 0)
    assert rows(found, "start", "stop", "length") == [(2, 3, 2), (5, 5, 1), (8, 8, 1)]
    assert rows(islands.runs(df, "job", "i", F.col("x") > 5), "run") == []
    assert rows(islands.sized_windows(found, "job", size=4, big_gap=2), "start", "stop") == [(2, 5), (8, 11)]
    assert rows(islands.edges(df, "job", "i", F.col("x") > 0), "start", "stop") == [(1, 3), (4, 5), (7, 8)]


def test_gestures_and_split(spark):
    s = [("none", 1, 0.05), ("one", 2, -0.5), ("one", 2, 0.5), ("two", 10, 0.3), ("two", 2, -0.2)]
    df = spark.createDataFrame([(t, d, v, i) for i, (t, d, v) in enumerate(s)], "trial string, dof int, value double, i int")
    assert rows(trials.gestures(df, ["trial"], "dof", "value", ["i"]), "trial", "gesture_id") == [("one", "dof_2_neg"), ("two", "combo_dof_10_pos-dof_2_neg")]
    t = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b")], "i long, g string")
    got = {m: rows(trials.split(t, "g", ["i"], 0.5, m).where("set = 'train'"), "i") for m in ("train_first", "train_last")}
    assert got == {"train_first": [(0,), (1,)], "train_last": [(3,), (4,)]}  # 2.5 rounds to 2
    assert rows(trials.split(t, "g", ["i"], 0.5, half_even=False), "i", "set")[:3] == [(0, "train"), (1, "train"), (2, "test")]
    assert trials.split(t, "g", ["i"], 0.4, "train_random").where("set = 'train'").count() == 2
    with pytest.raises(ValueError):
        trials.split(t, "g", ["i"], 0.5, "nothing")
    info = trials.trial_info(spark.createDataFrame([(1, 5, 8), (1, 10, 11)], "j long, a long, b long"), ["j"], "a", "b")
    assert rows(info, "relative_start_idx", "relative_stop_idx") == [(0, 3), (3, 4)]


def test_columns(spark):
    df = spark.createDataFrame([(0.1,), (0.6,), (-0.6,), (5.0,), (-0.1,)], "x double")
    assert [round(r.v, 6) for r in df.select(c.clip_gain(F.col("x")).alias("v")).collect()] == [0.0, 0.5, -0.5, 1.0, 0.0]
    one = spark.createDataFrame([("feat_1_2", "a\\b/c/", "x.kdf", [0.5, 0.0, -0.2])], "f string, p string, k string, a array<double>")
    got = one.select(c.clean_path(F.col("p")), c.swap_extension(F.col("k"), "kdf", "kef"), c.movement_code(F.col("a")), c.flex_extend(F.col("a"))).first()
    assert tuple(got) == ("a/b/c", "x.kef", [1, -3], [[True, False], [False, False], [False, True]])
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.select(c.safe_corr(F.col("x"), F.col("y"))).first()[0] == 0
    norm = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, -4.0), (2, -1.0), (3, 0.0), (3, 4.0)], "feature_id int, value double")
    assert rows(tidy.normalised(norm), "feature_id", "value") == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 0.0), (3, 0.0), (3, 2.0)]


def test_moments_and_selection_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    x[:, 3] = x[:, 0] + 0.1 * rng.normal(size=200)
    x[:, 5] = 2.0
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    got = {(r.i, r.j): r.corr for r in metrics.correlations(df, "v").collect()}
    want = np.corrcoef(x[:, :5].T)
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(5) for j in range(5)) and got[5, 0] == 0 == got[5, 5]
    steps = select.gram_schmidt(df, "v", 2, 3, 0.0).orderBy("step").collect()
    assert steps[0].channel == 1 and steps[0]["corr"] > 0.9
    scan = select.information_scan(df, "v", 0, [3, 2, 4], "bic").collect()
    assert len(scan) == 3 and scan[0].rss > scan[-1].rss
    with pytest.raises(Exception, match="not-a-number"):
        metrics.redundancy(spark.createDataFrame([([1.0, float("nan")],)], "v array<double>"), "v").collect()


def test_kalman_follows_a_linear_system(spark):
    rng = np.random.default_rng(1)
    n, x = 400, np.zeros((400, 2))
    a, h = np.array([[0.99, 0.05], [-0.05, 0.99]]), rng.normal(size=(5, 2))
    x[0] = [0.5, 0]
    for t in range(1, n):
        x[t] = a @ x[t - 1] + 0.01 * rng.normal(size=2)
    z = x @ h.T + 0.05 * rng.normal(size=(n, 5))
    df = spark.createDataFrame([(1, t, x[t].tolist(), z[t].tolist()) for t in range(n)], "job long, t long, s array<double>, f array<double>")
    m = decode.train(df, "job", "t", "s", "f", 2)
    assert np.abs(m.a - a).max() < 0.05 and np.abs(m.h - h).max() < 0.3
    got = np.array([r.predicted for r in decode.decode(df, "job", "t", "f", m).orderBy("t").collect()])
    assert (got[0] == 0).all() and np.corrcoef(got[50:, 0], x[50:, 0])[0, 1] > 0.9
    with pytest.raises(ValueError):
        decode.train_decoder("none", df, "job", "t", "s", "f", 2)


def test_third_order_decoder_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    n, period = 60, 1 / 30
    x = np.cumsum(rng.normal(size=(n, 2)), axis=0) / 5
    z = np.hstack([x, x**2]) @ rng.normal(size=(4, 5)) + 0.01 * rng.normal(size=(n, 5))

    def smooth(v):
        out = np.empty(len(v))
        for i in range(len(v)):
            lo = min(max(i - 4, 0), len(v) - 9)
            c = np.polyfit(np.arange(9), v[lo : lo + 9], 2)
            out[i] = np.polyval(c, i - lo)
        return out

    state = np.zeros((n, 6))
    for d in range(2):
        p = smooth(x[:, d])
        v = smooth(np.diff(p) * period)
        state[:, 3 * d] = p
        state[: n - 1, 3 * d + 1] = v
        state[: n - 2, 3 * d + 2] = np.diff(v) * period
    a = np.zeros((6, 6))
    for i in range(6):
        a[i, i] = 1
        if i < 5:
            a[i, i + 1] = period
    for d in range(2):
        a[3 * d + 2] = np.linalg.lstsq(state[:-1], state[1:, 3 * d + 2], rcond=None)[0]
    x1, x2 = state[:-1].T, state[1:].T
    w = (x2 @ x2.T - a @ (x1 @ x2.T)) / (n - 1)
    w = (w + w.T) / 2
    h = z.T @ state @ np.linalg.pinv(state.T @ state)
    q = (z.T @ z - h @ (z.T @ state).T) / n
    df = spark.createDataFrame([(1, t, x[t].tolist(), z[t].tolist()) for t in range(n)], "job long, t long, s array<double>, f array<double>").repartition(3)
    m = decode.train_decoder("third-order", df, "job", "t", "s", "f", 2)
    assert np.allclose(m.a, a, atol=1e-6) and np.allclose(m.w, w, atol=1e-9) and np.allclose(m.h, h, atol=1e-4) and np.allclose(m.q, q, atol=1e-6)
    f = decode.Filter(m)
    assert np.array([f.step(v) for v in z]).shape == (n, 2)


def test_nearest_takes_a_long_recording(spark):
    import time

    spent = []
    for n in (50_000, 200_000):
        frames = spark.range(n).select(F.lit(1).alias("job"), (F.col("id") * 10).alias("frame"))
        events = spark.range(n // 2).select(F.lit(1).alias("job"), (F.col("id") * 20 + 3).alias("ts"))
        began = time.time()
        found = align.nearest(events, frames, "job", "ts", "frame")
        assert found.where("frame_ts = ts - 3").count() == n // 2
        spent.append(time.time() - began)
    assert spent[1] < 20 and spent[1] < 10 * max(spent[0], 1)


def test_feature_sets_by_recording(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 2, 400))
    ticks = [1, 40, 90, 130, 220, 395]
    rows_ = [(j, c, i + 1, float(x[j, c, i])) for j in range(2) for c in range(2) for i in range(400)]
    samples = spark.createDataFrame(rows_, "job int, chan int, idx long, value double")
    marks = spark.createDataFrame([(j, t + j) for j in range(2) for t in ticks], "job int, tick long")
    r = registry.Recording(samples, marks, samples, marks, ["job"], params={"levels": 3, "frame": 64, "threshold": -2.0, "cap": 50})
    for name in registry.FEATURE_SETS:
        found = registry.extract(name, r)
        width = 2 * (3 if name.startswith("DWT") else 1)
        got = registry.wide(found, ["job"]).collect()
        assert len(got) == 12 and all(len(v.features) == width for v in got), name
    none = registry.extract("NFR", registry.Recording(samples, marks, recordings=["job"], params={"threshold": -2.0}))
    assert none.where("frame = 6 and feature = 0").count() == 4 and none.where("frame < 6 and feature < 0").count() == 0
    less = {(v.job, v.chan): v.feature for v in registry.extract("MAV", r).where("frame = 3").collect()}
    bare = {(v.job, v.chan): v.feature for v in registry.extract("MAV", registry.Recording(samples, marks, recordings=["job"], params={"cap": 50})).where("frame = 3").collect()}
    assert all(less[k] < bare[k] for k in less)
    with pytest.raises(ValueError):
        registry.extract("none", r)


def test_load_cuts_training_and_baseline(spark):
    samples = spark.range(1000).select(F.lit(0).alias("chan"), (F.col("id") + 7).alias("t"), F.col("id").cast("double").alias("value"))
    samples = samples.unionByName(samples.withColumn("chan", F.lit(500)))
    frame = lambda *t: spark.createDataFrame([(float(v),) for v in t], "nip_time double")
    r = registry.load(samples, frame(100, 133.5, 160), frame(10, 20), 5)
    got = r.samples.orderBy("idx").collect()
    assert (got[0].idx, got[0].value, got[-1].idx) == (1, 98.0, 61) and {v.chan for v in got} == {0}
    assert rows(r.ticks, "tick") == [(1,), (35,), (61,)] and r.baseline.count() == 11


def test_short_channels_are_left_out(spark):
    from tracelake.functions import kernels

    df = spark.createDataFrame([(1, i, 1.0) for i in range(12)] + [(2, i, 1.0) for i in range(13)], "c long, i long, v double")
    assert rows(framing.filtered(df, "c", "i", "v", *kernels.HIGH_PASS, True).select("c").distinct(), "c") == [(2,)]


def test_categories_on_a_small_catalogue(spark):
    from tracelake.sources.files import annotations

    two, one = {"flexion": 5, "extension": 4}, {"flexion": 6}
    job = lambda **k: {"kinematics": {d: {"type": t, "gestures": g} for d, (t, g) in k.items()}}
    ind, com = "independent", "combined"
    jobs = {
        1: job(**{d: (ind, two) for d in catalog.TASKA}),
        2: job(d1=(ind, one), d10=(ind, two), d12=(com, two)),
        3: job(d1=(ind, two), d12=(ind, one)),
        4: job(d10=(ind, two)),
        5: {},
    }
    entries = annotations(spark, jobs)
    got = {m: rows(catalog.dof_categories(entries, m), "job_id", "category") for m in ("all", "bidirectional", "independent")}
    every = [(1, n) for n in ("1DOF-ETD", "2DOF-ETDR", "3DOF-ETDRF", "6DOF-DEKA", "8DOF-TASKA")]
    assert got["all"] == every + [(2, "1DOF-ETD"), (2, "2DOF-ETDR"), (2, "3DOF-ETDRF"), (3, "1DOF-ETD"), (3, "2DOF-ETDR"), (4, "OTHER"), (5, "OTHER")]
    assert got["bidirectional"] == every + [(2, "OTHER"), (3, "1DOF-ETD"), (3, "2DOF-ETDR"), (4, "OTHER"), (5, "OTHER")]
    assert got["independent"] == every + [(2, "OTHER"), (3, "1DOF-ETD"), (4, "OTHER"), (5, "OTHER")]
    assert rows(catalog.direction_counts(entries, "type", "n_gestures", "min_trials"), "type", "uni", "bi", "uni_trials", "bi_trials") == [
        (com, 0, 1, 0, 4), (ind, 2, 11, 12, 44),
    ]


@pytest.mark.skipif("ANNOTATIONS" not in os.environ, reason="no annotations are named")
def test_category_counts_of_a_whole_catalogue(spark):
    from tracelake.sources.files import read_annotations

    entries = read_annotations(spark, os.environ["ANNOTATIONS"]).cache()
    names = ["8DOF-TASKA", "6DOF-DEKA", "3DOF-ETDRF", "2DOF-ETDR", "1DOF-ETD", "OTHER"]
    for mode, deka, want in (
        ("bidirectional", catalog.DEKA, [58, 102, 116, 116, 131, 24]), ("all", catalog.DEKA, [72, 111, 117, 119, 144, 11]),
        ("all", catalog.DEKA_5, [72, 114, 117, 119, 144, 11]), ("independent", catalog.DEKA_5, [58, 104, 116, 116, 131, 24]),
    ):
        got = {r.category: r["count"] for r in catalog.dof_categories(entries, mode, deka).groupBy("category").count().collect()}
        assert [got[n] for n in names] == want
    sums = {r.type: tuple(r)[1:] for r in catalog.direction_counts(entries, "type", "n_gestures", "min_trials").collect()}
    assert sums["combined"] == (32, 123, 205, 1009) and sums["independent"] == (78, 862, 608, 6969)


def test_movement_splits_and_down_selection(spark):
    rows_ = [(1, 10 * (i + 1), c) for i, c in enumerate([[1], [1, 2], [1], [-3], [1], [1, 2]])]
    t = spark.createDataFrame(rows_, "job long, stop long, code array<int>")
    got = {r.stop: (r.start, r.set) for r in trials.split_movements(t, "job", "code", "stop", 0.7).collect()}
    assert got == {10: (0, "train"), 20: (10, "test"), 30: (20, "train"), 40: (30, "test"), 50: (40, "test"), 60: (50, "test")}
    both = {r.stop: r.set for r in trials.split_movements(t, "job", "code", "stop", 0.5, "last", True, False).collect()}
    assert both == {10: "test", 30: "test", 50: "train", 60: "train", 40: "test"}
    for bad in ({"percent": 0.0}, {"mode": "none"}):
        with pytest.raises(ValueError):
            trials.split_movements(t, "job", "code", "stop", **bad)
    frames = spark.createDataFrame([(1, v, [v / 10, 0.0, 1.0], [1.0 * v, 2.0]) for v in range(0, 61, 5)], "job long, at long, kin array<double>, feat array<double>")
    sets = {r.at: (r.train, r.test) for r in trials.frame_sets(frames, trials.split_movements(t, "job", "code", "stop", 0.7), "job", "at", "stop", 7.0).collect()}
    assert sets[5] == (True, False) and sets[10] == (True, True) and sets[60] == (False, True) and len(sets) == 13
    split = trials.split_movements(t, "job", "code", "stop", 0.7)
    ranges = rows(trials.test_ranges(frames, split, "job", "at", "code", "stop", 7.0), "relative_start", "relative_stop", "stop")
    assert ranges == [(1, 3, 50), (4, 6, 20), (7, 9, 60), (10, 12, 40)]
    kept = trials.down_select(frames, split.where("pos = 1 and size(code) = 1"), "job", "at", "start", "stop", [3, 1], "kin", "feat", 9.0, [2])
    assert rows(kept, "place", "at", "kin", "feat")[:2] == [(1, 0, [1.0, 0.0], [2.0]), (2, 5, [1.0, 0.5], [2.0])] and kept.count() == 6
    assert rows(trials.active_dofs(frames, "job", "kin"), "active") == [([1, 3],)]


def test_wide_evaluation_and_decoding_against_numpy(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(300, 3)), rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    df = spark.createDataFrame([(1, i, x[i].tolist(), z[i].tolist()) for i in range(300)], "job long, t long, s array<double>, f array<double>").repartition(4)
    got = {(r.measure, r.place): r.value for r in metrics.evaluate(df, "f", "s", 3, 5).collect()}
    sv = np.linalg.svd(z - z.mean(axis=0), compute_uv=False) ** 2
    assert all(abs(got["pca_vaf", i + 1] - 100 * sv[i] / sv.sum()) < 1e-6 for i in range(5))
    both = np.corrcoef(np.hstack([x, z]).T)
    assert abs(got["corr_xx", 1] - np.abs(both[3:, 3:]).mean()) < 1e-9 and all(abs(got["corr_xy", i + 1] - np.abs(both[i, 3:]).mean()) < 1e-9 for i in range(3))
    m = decode.train(df, "job", "t", "s", "f", 3)
    a = (x[1:].T @ x[:-1]) @ np.linalg.pinv(x[:-1].T @ x[:-1])
    h = (z.T @ x) @ np.linalg.pinv(x.T @ x)
    assert np.allclose(m.a, a) and np.allclose(m.h, h) and np.allclose(m.q, (z.T @ z - h @ (z.T @ x).T) / 300)


def test_movement_splits_cut_decimal_shares_down(spark):
    # In binary 0.7 x 90 is a little under 63.
    t = spark.createDataFrame([(1, i, [1]) for i in range(90)], "job long, stop long, code array<int>")
    for mode, ends in (("first", range(63)), ("last", range(27, 90))):
        train = trials.split_movements(t, "job", "code", "stop", 0.7, mode).where("set = 'train'")
        assert sorted(r.stop for r in train.collect()) == list(ends)
