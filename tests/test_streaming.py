import numpy as np
from pyspark.sql import functions as F

from tracelake.operators import decode, framing
from tracelake.streaming import stateful


def parts(spark, tmp_path, frame, n):
    """A folder of files that the stream takes one at a time, in order of time."""
    import os
    import time

    for i in range(n):
        frame.where(F.col("i") % 1000 >= 0).where((F.col("i") >= i * 25) & (F.col("i") < (i + 1) * 25)).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for f in os.listdir(tmp_path / f"b{i}"):
            if f.startswith("part"):
                (tmp_path / "in").mkdir(exist_ok=True)
                os.rename(tmp_path / f"b{i}" / f, tmp_path / "in" / f"{i:03d}.parquet")
                os.utime(tmp_path / "in" / f"{i:03d}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_state_is_carried_between_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(c, i, float(v)) for c in (1, 2) for i, v in enumerate(rng.normal(size=100))], "c long, i long, v double")
    stream = parts(spark, tmp_path, df, 4)
    got = stateful.run_available(stateful.trailing_mean_abs(stream, "c", "i", "v", 9)).orderBy("c", "i").collect()
    want = framing.trailing_mean_abs(df, "c", ["i"], "v", 9, "mav").orderBy("c", "i").collect()
    assert np.allclose([r.mav for r in got], [r.mav for r in want]) and len(got) == 200
    hits = stateful.run_available(stateful.spikes(stream, "c", "i", "v", 1.0, 4))
    plain = framing.detect_spikes(df, "c", "i", "v", 1.0, 4)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, plain.collect()))


def test_kalman_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(1, i, rng.normal(size=2).tolist(), rng.normal(size=3).tolist()) for i in range(75)], "c long, i long, s array<double>, f array<double>")
    m = decode.train(df, "c", "i", "s", "f", 2)
    got = stateful.run_available(stateful.kalman(parts(spark, tmp_path, df, 3), "c", "i", "f", m)).orderBy("i").collect()
    want = decode.decode(df, "c", "i", "f", m).orderBy("i").collect()
    assert np.allclose([r.predicted for r in got], [r.predicted for r in want])
