"""Each query against its SQL on the smallest tables, and that all of them run."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tracelake.plans import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=key)
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    order = [list(rel.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and x == pytest.approx(float(y), abs=2e-6)), (name, a, b)


@pytest.mark.parametrize("name", ["kalman_decode", "stream_kalman"])
def test_decoded_zeros_keep_their_sign(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    rows = [(i, [*map(float, rng.normal(size=8) * 2e-6), *map(float, rng.normal(size=56))], i % 2) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted((r[0], r[1], *map(repr, r[2])) for r in con.sql(SQL[name]).fetchall())
    got = sorted((r.label, r.vec_id, *map(repr, r.predicted)) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == want and any("-0.0" in r for r in got)
