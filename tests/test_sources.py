import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.sources import files, nsx


@pytest.fixture
def recording(tmp_path):
    x = np.arange(700 * 5, dtype=np.int16).reshape(700, 5)
    nsx.write(str(tmp_path / "a.ns5"), x, nip_start=1000)
    return tmp_path, x


def load(spark, path, **options):
    spark.dataSource.register(nsx.NsxSource)
    reader = spark.read.format("nsx").option("chunk_samples", 100).option("channels", 2)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(path))


def test_nsx_whole_and_ranges(spark, recording):
    path, x = recording
    df = load(spark, path)
    got = {(r.chan, r.chunk): r for r in df.collect()}
    scale = (8191 + 8192) / 65535
    assert len(got) == 5 * 7 and got[2, 3].t0 == 1300 and got[2, 3].label == "chan3"
    assert np.allclose(got[2, 3].samples, x[300:400, 2] * scale, rtol=1e-5)
    part = load(spark, path, start=150, stop=260).where("chan = 1").orderBy("chunk").collect()
    assert np.allclose(sum((r.samples for r in part), []), x[149:260, 1] * scale, rtol=1e-5)
    assert {r.range_id for r in load(spark, path, ranges="1-50,301-350").select("range_id").distinct().collect()} == {0, 1}


def test_nsx_filters_reach_the_partitions(spark, recording):
    path, _ = recording
    df = load(spark, path).where("chunk >= 2 and chunk < 4 and chan = 4")
    assert sorted((r.chunk, r.chan) for r in df.collect()) == [(2, 4), (3, 4)]
    assert df.rdd.getNumPartitions() == 1


def test_nsx_packets(tmp_path):
    nsx.write(str(tmp_path / "p.ns5"), np.ones((1, 2), np.int16), nip_start=5)
    more = np.full((30, 2), 7, np.int16)
    with open(tmp_path / "p.ns5", "ab") as f:
        f.write(struct.pack("<BII", 1, 90, 40) + more.tobytes())  # says 40, holds 30
    head = nsx.read_header(str(tmp_path / "p.ns5"))
    assert (head.nip_start, head.packet_start, head.n_samples, head.pauses) == (5, 90, 30, True)
    nsx.write(str(tmp_path / "q.ns5"), more)
    with open(tmp_path / "q.ns5", "ab") as f:
        f.write(struct.pack("<BII", 1, 90, 3) + more[:3].tobytes())
    assert nsx.read_header(str(tmp_path / "q.ns5")).n_samples == 30
    nsx.write_range(str(tmp_path / "q.ns5"), str(tmp_path / "r.ns5"), 5, 9)
    head = nsx.read_header(str(tmp_path / "r.ns5"))
    assert (head.n_samples, head.packet_start) == (5, 4)


def test_nsx_header_byte_by_byte(spark, tmp_path):
    x = np.arange(24, dtype="<i2").reshape(12, 2)
    body = b"NEURALCD" + bytes([2, 3]) + struct.pack("<I", 314 + 2 * 66) + b"30 kS/s".ljust(16, b"\0") + b"comment".ljust(252, b"\xff")
    body += struct.pack("<III", 777, 1, 30000) + struct.pack("<8H", *range(8)) + struct.pack("<I", 2)
    for i in range(2):
        channel = b"CC" + struct.pack("<H", 40 + i) + f"elec{i}".encode().ljust(16, b"\0") + b"\1\2" + struct.pack("<4h", -1000, 1000, -500, 500)
        body += channel + b"uV".ljust(16, b"\0") + b"\0" * 20
    # A packet of length 0 reaches to the end of the file.
    (tmp_path / "z.ns5").write_bytes(body + struct.pack("<BII", 1, 800, 0) + x.tobytes())
    head = nsx.read_header(str(tmp_path / "z.ns5"))
    assert (head.version, head.nip_start, head.packet_start, head.n_samples, head.period, head.scale) == ("2.3", 777, 800, 12, 1, 0.5)
    got = load(spark, tmp_path).orderBy("chan").collect()
    assert [(r.t0, r.label, r.samples) for r in got] == [(800, f"elec{c}", (x[:, c] * 0.5).tolist()) for c in range(2)]


def test_nsx_old_header(tmp_path):
    x = np.arange(12, dtype="<i2").reshape(6, 2)
    (tmp_path / "o.ns2").write_bytes(b"NEURALSG" + b"\0" * 16 + struct.pack("<II", 30, 2) + struct.pack("<2I", 1, 2) + x.tobytes())
    head = nsx.read_header(str(tmp_path / "o.ns2"))
    assert (head.version, head.n_samples, head.period) == ("2.1", 6, 30)


def test_kdf(spark, tmp_path):
    frames = np.arange(4 * 6, dtype="<f4").reshape(4, 6)
    (tmp_path / "t.kdf").write_bytes(np.array([1, 3, 2, 0, 0], "<f4").tobytes() + frames.tobytes() + b"\0\0")
    got = files.read_kdf(spark, str(tmp_path)).orderBy("frame").collect()
    assert len(got) == 4 and got[1].nip_time == 6 and got[1].features == [7, 8, 9] and got[1].kinematics == [10, 11] and got[1].targets is None
    assert files.parse_kdf(np.zeros(5, "<f4").tobytes()).empty


def test_kef(spark, tmp_path):
    text = "SS.TargOnTS=[10];SS.TrialTS=[20.5];SS.MvntMat=[1 0 0 0;0 -1 .5 2];\r\nSS.TargOnTS=[30];SS.TrialTS=[];SS.MvntMat=[1 0 0 0];\r\n__import__('os')\r\n"
    (tmp_path / "e.kef").write_bytes(text.encode())
    got = files.read_kef(spark, str(tmp_path / "e.kef")).collect()
    assert [(r.targ_on_ts, r.trial_ts, r.mvnt_mat) for r in got] == [(10.0, 20.5, [[1, 0, 0, 0], [0, -1, 0.5, 2]])]


def test_manifest_listing_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", "d", "t.kdf", "b.kdf", "e.kef", "f.ns5")], files.MANIFEST)
    files.write_tsv(df, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).collect() == df.collect()
    for d in ("x", "y"):
        (tmp_path / "l" / d).mkdir(parents=True)
        (tmp_path / "l" / d / "a.ns5").write_bytes(b"12")
    (tmp_path / "l" / "x" / "b.ns5").write_bytes(b"1")
    got = {r.dir[-1]: (r.path[-5:], r.several) for r in files.first_per_dir(files.listing(spark, str(tmp_path / "l"), "*.ns5")).collect()}
    assert got == {"x": ("a.ns5", True), "y": ("a.ns5", False)}
    keys = spark.createDataFrame([("f", "features"), ("g", "features"), ("g", "computation_times")], "path string, key string")
    assert [tuple(r) for r in files.missing_keys(keys, ["features", "computation_times"]).collect()] == [("f", ["computation_times"])]
    feats = spark.createDataFrame([(1, "NFR", 0, [1.0])], "job_id int, feature_set string, frame long, features array<double>")
    files.write_features(feats, str(tmp_path / "w"))
    with pytest.raises(Exception):
        files.write_features(feats, str(tmp_path / "w"))
    files.write_features(feats, str(tmp_path / "w"), overwrite=True)
    feats.write.parquet(str(tmp_path / "s" / "events.parquet"))
    assert set(files.load_session(spark, str(tmp_path / "s"))) == {"events"}
    starts = spark.createDataFrame([(1, 5, None), (2, None, 6), (3, None, None)], "s long, rec_start long, ss_rec_start long")
    assert [(r.start, r.unknown) for r in files.clock_starts(starts).orderBy("s").collect()] == [(5, False), (6, False), (None, True)]
    assert files.load_config("a: [1, 2]") == {"a": [1, 2]} and '"a"' in files.to_json({"a": 1})


def test_sqlite_catalogue(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "catalogue.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE files (participant_id TEXT, session_dir TEXT, training_filename TEXT, baseline_filename TEXT)")
        con.executemany("INSERT INTO files VALUES (?, ?, ?, ?)", [("P1", f"s{i}", "t.kdf", None) for i in range(25)])
    schema = "participant_id string, session_dir string, baseline_filename string"
    found = files.read_sqlite(spark, path, "SELECT participant_id, session_dir, baseline_filename FROM files WHERE training_filename IS NOT NULL", schema, batch=10)
    got = found.collect()
    assert len(got) == 25 and got[0].baseline_filename is None and {r.session_dir for r in got} == {f"s{i}" for i in range(25)}
    assert files.read_sqlite(spark, path, "SELECT participant_id, session_dir, baseline_filename FROM files WHERE 0", schema).count() == 0


def test_files_without_any_key_are_reported(spark):
    found = spark.createDataFrame([("a", "features"), ("a", "computation_times"), ("b", "features")], "path string, key string")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    lack = files.missing_keys(found, ["features", "computation_times"], files=listed)
    assert [r.value for r in files.missing_report(lack).collect()] == ["b: lacks computation_times", "c: lacks computation_times, features"]


def test_only_a_missing_table_is_left_out_of_a_session(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "events.parquet"))
    assert set(files.load_session(spark, str(tmp_path))) == {"events"}
    (tmp_path / "kinematics.parquet").mkdir()
    (tmp_path / "kinematics.parquet" / "part.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        files.load_session(spark, str(tmp_path))
