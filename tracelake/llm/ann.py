"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables hashes a vector to the cell floor((a x + b) / w) of
Gaussian projections.  Every row is indexed in every table.  A query visits
``probes`` cells of each table in the estimated order of success: sets of steps
to neighbouring cells, by the expected squares of the distances from the query
to the walls they cross, the nearest wall standing first for each query.  The
rows met in any table are candidates, which are ranked by their exact distance.

The number of projections, the cell width and the number of probes are chosen on
a sample: ``SAMPLE`` rows are measured against all rows, and of the settings
whose probes would meet ``RECALL`` of their true neighbours, that with the
least work is taken: rows met (their share of ``SAMPLE_ROWS`` rows, times all
rows) and cells visited.  If no setting would, the one
nearest to it is, and its probes are not reduced.

What moves.  The index holds (key, id, code) with a code of one byte a
component and its error; by the triangle inequality codes bound each distance,
and only rows that may belong to a query's k nearest are measured on the
vectors themselves.  Equal vectors are indexed under their k + 1 least ids and
searched once.  Cells are dealt to groups of bounded rows and probes; a cell
over ``CELL_ROWS`` rows or ``CELL_QUERIES`` queries is cut into blocks, each
block of rows meeting each block of queries.

A query that has met fewer than k rows is measured against all rows of its
length, in blocks of both sides; it gets k rows, or all others if they are fewer.

Defined results: rows whose vector is null, zero or holds null or non-finite
components take no part, nor do rows or queries with a null id; vectors of
another length are never met; an id's own rows are never its neighbours; of
rows that repeat an id the nearest counts; ties go to the smaller id; an empty
table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, map_arrow, materialize
from tracelake.llm.vectors import matrix, packed, usable

TABLES = 8
HASHES = (4, 6, 8, 10, 12, 14, 16, 20, 24)
WIDTHS = (1.5, 2.5, 4.0)
PROBES = (16, 64, 256, 1024)
RECALL = 0.97
SAMPLE = 48
SAMPLE_ROWS = 2048
GROUP_ROWS = 16384
GROUP_PROBES = 1 << 18
CELL_ROWS = 4096
CELL_QUERIES = 4096
EXACT_QUERIES = 4096


@lru_cache(maxsize=64)
def probe_sets(hashes: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Sets of walls, by their places in order of distance, least expected sum of
    squares first; no set holds both walls of one projection (places j and
    2 x hashes - 1 - j)."""
    m = 2 * hashes
    # Expected squares of ordered distances to walls, in units of the width.
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4.0 * (hashes + 1) * (hashes + 2))
    far = 1 - (m + 1 - j) / (hashes + 1) + (m + 1 - j) * (m + 2 - j) / (4.0 * (hashes + 1) * (hashes + 2))
    cost = np.where(j <= hashes, near, far)
    out: list[tuple[int, ...]] = [()]
    queue = [(float(cost[0]), (0,))] if m else []
    while queue and len(out) < probes:
        total, steps = heapq.heappop(queue)
        if len({min(s, m - 1 - s) for s in steps}) == len(steps):
            out.append(steps)
        last = steps[-1]
        if last + 1 < m:
            more = float(cost[last + 1])
            heapq.heappush(queue, (total - float(cost[last]) + more, (*steps[:-1], last + 1)))
            heapq.heappush(queue, (total + more, (*steps, last + 1)))
    return tuple(out)


@lru_cache(maxsize=64)
def _template(hashes: int, probes: int) -> np.ndarray:
    """``probe_sets`` as a table [probe, place], 2 x hashes where there is none."""
    sets = probe_sets(hashes, probes)
    out = np.full((len(sets), max(map(len, sets)) or 1), 2 * hashes)
    for i, s in enumerate(sets):
        out[i, : len(s)] = s
    return out


@lru_cache(maxsize=256)
def _projections(size: int, table: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """Directions, shifts (in widths), and the multipliers and start of the keys."""
    rng = np.random.default_rng([size, table, 17])
    directions, shifts = rng.normal(size=(size, 64)), rng.uniform(0, 1, 64)
    multipliers = rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    start = rng.integers(0, 1 << 63, dtype=np.uint64)
    return directions[:, :hashes], shifts[:hashes], multipliers[:hashes], start


@dataclass(frozen=True)
class Setting:
    hashes: int
    width: float
    probes: int
    tables: int = TABLES

    def keys(self, x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """Keys [row, probe] of the cells that rows visit, their own first."""
        directions, shifts, multipliers, start = _projections(x.shape[1], table, self.hashes)
        place = x @ directions / self.width + shifts
        cell = np.floor(place)
        gaps = place - cell
        with np.errstate(over="ignore"):
            own = start + (cell.astype(np.int64).astype(np.uint64) * multipliers).sum(axis=1, dtype=np.uint64)
            if probes == 1 or not self.hashes:
                return own[:, None].view(np.int64)
            # Distances to lower walls, then to upper ones, and the change of the key.
            walls = np.argsort(np.hstack([gaps, 1 - gaps]), axis=1, kind="stable")
            change = np.r_[-multipliers.view(np.int64), multipliers.view(np.int64), 0].view(np.uint64)
            walls = np.hstack([walls, np.full((len(x), 1), 2 * self.hashes)])
            template = _template(self.hashes, probes)
            out = np.repeat(own[:, None], len(template), axis=1)
            for column in template.T:
                out += change[walls[:, column]]
        return out.view(np.int64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0))


def choose(sample: np.ndarray, near: list[np.ndarray], rows: np.ndarray, total: int, recall: float = RECALL, tables: int = TABLES) -> Setting:
    """The setting that would meet ``recall`` of each sampled row's nearest
    vectors (``near``) at the least work, in rows met and cells visited; ``rows``
    stand for all ``total``."""
    scale = np.concatenate([np.sqrt(((v - q) ** 2).sum(axis=1)) for q, v in zip(sample, near)])
    scale = float(np.median(scale[scale > 0])) if (scale > 0).any() else 1.0
    flat, of = np.concatenate(near), np.repeat(np.arange(len(near)), list(map(len, near)))
    found: list[tuple[bool, float, Setting]] = []
    for hashes in HASHES:
        for width in WIDTHS:
            setting = Setting(hashes, width * scale, PROBES[-1], tables)
            first = np.full(len(flat), PROBES[-1])
            met = np.full((len(sample), len(rows)), PROBES[-1], np.int32)
            for t in range(tables):
                visited = setting.keys(sample, t, PROBES[-1])
                near_keys, row_keys = setting.keys(flat, t)[:, 0], setting.keys(rows, t)[:, 0]
                for i, keys in enumerate(visited):
                    order = np.argsort(keys, kind="stable")
                    for wanted, ranks, at in ((near_keys[of == i], first, of == i), (row_keys, met, i)):
                        spot = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
                        rank = np.where(keys[order[spot]] == wanted, order[spot], PROBES[-1])
                        ranks[at] = np.minimum(ranks[at], rank)
            for probes in PROBES:
                share, reached = float((met < probes).mean()), float((first < probes).mean())
                work = share * total + probes * tables
                found.append((reached >= recall, work if reached >= recall else -reached, Setting(hashes, width * scale, probes, tables)))
    return min(found, key=lambda f: (not f[0], f[1]))[2]


def nearest_in(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query its k nearest rows of other ids (query id, id, distance).

    Rows no farther than the k-th by products of vectors, with a margin for
    rounding, are measured again by differences, so ties are exact ties."""
    length = (x * x).sum(axis=1)
    for lo in range(0, len(q), 64):
        part = q[lo : lo + 64]
        d2 = (part * part).sum(axis=1)[:, None] + length - 2 * part @ x.T
        d2[q_ids[lo : lo + 64, None] == x_ids] = np.inf
        bound = np.partition(d2, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(part), np.inf)
        slack = 1e-9 * (1 + length.max() + (part * part).sum(axis=1))
        for i in range(len(part)):
            near = np.flatnonzero((d2[i] <= bound[i] + slack[i]) & np.isfinite(d2[i]))
            if not len(near):
                continue
            d = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
            order = np.lexsort((x_ids[near], d))[:k]
            yield np.full(len(order), q_ids[lo + i]), x_ids[near][order], d[order]


def _first(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    out = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))
    out = out.sort_values(["query_id", "score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
    return out.groupby("query_id", sort=False).head(k)


def _measure(k: int):
    """All rows of a block against all queries of a block, of one length."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            ids = rows["id"].to_numpy()
            # So many nearest rows hold k ids, however an id repeats.
            most = k * int(np.unique(ids, return_counts=True)[1].max())
            found = list(nearest_in(matrix(queries["vector"]), queries["id"].to_numpy(), matrix(rows["vector"]), ids, most))
        empty = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        return _first(found or empty, k)

    return run


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-byte codes of the rows, their units, and the distance between each row
    and what its code stands for (with a margin for single precision)."""
    unit = np.abs(x).max(axis=1) / 127
    unit = np.where(unit > 0, unit, 1.0)
    code = np.rint(x / unit[:, None]).astype(np.int8)
    error = np.sqrt(((code * unit[:, None] - x) ** 2).sum(axis=1))
    return code, unit, error + 1e-5 * np.sqrt((x * x).sum(axis=1))


def _indexed(setting: Setting):
    """(key, id, code, unit, error) of a row in each table."""

    def run(vec_id: pa.Array, vector: pa.Array) -> dict:
        ids, raw = vec_id.to_numpy(zero_copy_only=False), vector.to_pylist()
        out: dict[str, list] = {n: [] for n in ("key", "id", "code", "unit", "error")}
        widths = np.array([len(v) for v in raw])
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            x = matrix([raw[i] for i in own])
            code, unit, error = encode(x)
            codes = [c.tobytes() for c in code]
            for t in range(setting.tables):
                out["key"].append(setting.keys(x, t)[:, 0])
                out["id"].append(ids[own])
                out["code"] += codes
                out["unit"].append(unit)
                out["error"].append(error)
        return {n: v if n == "code" else np.concatenate(v) if v else [] for n, v in out.items()}

    return run


def _asked(setting: Setting):
    """(key, id) of each cell a query visits; a cell that two tables share once."""

    def run(vec_id: pa.Array, vector: pa.Array) -> dict:
        ids, raw = vec_id.to_numpy(zero_copy_only=False), vector.to_pylist()
        keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        widths = np.array([len(v) for v in raw])
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            x = matrix([raw[i] for i in own])
            for t in range(setting.tables):
                visited = setting.keys(x, t, setting.probes)
                keys.append(visited.ravel())
                owners.append(np.repeat(ids[own], visited.shape[1]))
        return {"key": np.concatenate(keys), "id": np.concatenate(owners)}

    return run


def _listed(setting: Setting, groups: int):
    """(group, id, keys) of the cells a query visits: a row for each group."""
    asked = _asked(setting)

    def run(vec_id: pa.Array, vector: pa.Array) -> dict:
        found = asked(vec_id, vector)
        key, owner = found["key"], found["id"]
        group = np.mod(key >> 32, groups)
        order = np.lexsort((owner, group))
        key, owner, group = key[order], owner[order], group[order]
        first = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(owner) != 0)][: len(key)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), pa.array(key, pa.int64()))
        return {"group": group[first], "id": owner[first], "keys": lists}

    return run


def _meet(k: int):
    """Rows of a group that may be among the k nearest of a query, with bounds."""

    def decode(pdf: pd.DataFrame, at: np.ndarray) -> np.ndarray:
        code = np.frombuffer(b"".join(pdf["code"].iloc[at]), np.int8).reshape(len(at), -1)
        return code.astype(np.float32) * pdf["unit"].to_numpy(np.float32)[at][:, None]

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(rows) and len(queries):
            row_width, query_width = rows["code"].map(len).to_numpy(), queries["code"].map(len).to_numpy()
            for w in np.unique(query_width):
                mine, asks = np.flatnonzero(row_width == w), np.flatnonzero(query_width == w)
                if not len(mine):
                    continue
                mine = mine[np.argsort(rows["key"].to_numpy()[mine], kind="stable")]
                keys, ids, errors = (rows[c].to_numpy()[mine] for c in ("key", "id", "error"))
                x, q = decode(rows, mine), decode(queries, asks)
                lengths = (x * x).sum(axis=1)
                for i, at in enumerate(asks):
                    wanted = np.unique(np.asarray(queries["keys"].iloc[at], np.int64))
                    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                    size = hi - lo
                    if not size.sum():
                        continue
                    spot = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                    spot = spot[np.unique(ids[spot], return_index=True)[1]]
                    d = np.sqrt(np.maximum(lengths[spot] + q[i] @ q[i] - 2 * (x[spot] @ q[i]), 0)).astype(float)
                    slack = errors[spot] + float(queries["error"].iloc[at]) + 1e-5 * (1 + d)
                    high = d + slack
                    bound = np.partition(high, k - 1)[k - 1] if k < len(high) else np.inf
                    keep = d - slack <= bound
                    out.append((np.full(keep.sum(), queries["id"].iloc[at]), ids[spot[keep]], (d - slack)[keep], high[keep]))
        return pd.DataFrame(dict(zip(("q", "vec_id", "low", "high"), map(np.concatenate, zip(*out)))))

    return run


def _sampled(rows: DataFrame, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """``SAMPLE`` rows of the commonest length, their k nearest by measuring all
    rows, and ``SAMPLE_ROWS`` other rows; all bounded by their numbers."""
    order = F.xxhash64("vec_id", F.lit(5))
    picked = rows.orderBy(order, "vec_id").limit(SAMPLE + SAMPLE_ROWS).collect()
    sizes = [len(r.vector) for r in picked]
    common = max(set(sizes), key=sizes.count)
    picked = [r for r in picked if len(r.vector) == common]
    asked, others = picked[:SAMPLE], picked[SAMPLE:] or picked
    q, q_ids = matrix([r.vector for r in asked]), np.arange(len(asked))
    own = np.array([r.vec_id for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes]]] = [[] for _ in asked]
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = [i for i, v in enumerate(raw) if len(v) == common]
            if not at:
                continue
            x, x_ids = matrix([raw[i] for i in at]), np.array([ids[i] for i in at])
            d = _distances(q, x)
            d[own[:, None] == x_ids] = np.inf
            for i in q_ids:
                least = np.argpartition(d[i], k - 1)[:k] if k < len(at) else np.arange(len(at))
                best[i] = heapq.nsmallest(k, best[i] + [(float(d[i, j]), raw[at[j]]) for j in least if np.isfinite(d[i, j])])
        found = [(i, s, v) for i, b in enumerate(best) for s, v in b]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.binary()))], ["q", "score", "vector"])

    near = rows.select("vec_id", "vector").mapInArrow(run, "q int, score double, vector binary")
    least = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vector"))).where(F.col("rank") <= k)
    lists: list[list[bytes]] = [[] for _ in asked]
    for r in least.collect():
        lists[r.q].append(bytes(r.vector))
    some = [i for i, v in enumerate(lists) if v]
    return q[some], [matrix(lists[i]) for i in some], matrix([r.vector for r in others])


def ann(
    vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, recall: float = RECALL,
    setting: Setting | None = None, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding) nearest to those with ``is_query``:
    query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    bounded_batches(spark, 2048)
    rows = vectors.where(usable(F.col("embedding"))).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query"))
    every = materialize(packed(rows, "is_query"))
    total = every.count()
    # Under its k + 1 least ids a vector gives each query all it may return of it.
    copies = Window.partitionBy("vector").orderBy("vec_id")
    held = every.select("vec_id", "vector").distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    held = materialize(held)
    wanted = every.where("is_query").select("vec_id", "vector").distinct()
    classes = materialize(wanted.groupBy("vector").agg(F.min("vec_id").alias("vec_id")))
    if setting is None and total > k:
        q, near, others = _sampled(held, k)
        setting = choose(q, near, others, total, recall, tables) if len(q) else None
    setting = setting or Setting(0, 1.0, 1, 1)
    n_asked = classes.count()
    groups = max(1, math.ceil(total * setting.tables / group_rows) + math.ceil(n_asked * setting.tables * setting.probes / GROUP_PROBES))

    index = map_arrow(held.select("vec_id", "vector"), _indexed(setting), "key long, id long, code binary, unit double, error double")
    asked = map_arrow(classes.select("vec_id", "vector"), _asked(setting), "key long, id long")
    # Cells over the bounds, and into how many blocks their two sides are cut.
    full = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS)
    # No cell is visited by more queries than there are.
    busy = asked.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CELL_QUERIES)
    if n_asked <= CELL_QUERIES:
        busy = spark.createDataFrame([], "key long, m long")
    large = materialize(
        full.join(busy, "key", "full_outer").select(
            "key",
            F.ceil(F.coalesce("n", F.lit(1)) / CELL_ROWS).cast("int").alias("row_blocks"),
            F.ceil(F.coalesce("m", F.lit(1)) / CELL_QUERIES).cast("int").alias("query_blocks"),
        )
    )

    def dealt(side: DataFrame, own: str, other: str, how: str) -> DataFrame:
        cut = side.join(large, "key", how).select(
            *side.columns, F.col("row_blocks").isNotNull().alias("is_large"), F.pmod(F.xxhash64("id"), F.coalesce(f"{own}_blocks", F.lit(1))).cast("int").alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_blocks", F.lit(1)) - 1)).alias(f"{other}_block"),
        )
        # The blocks of a cell keep apart under keys of their own, so the cell's
        # own key, which the lists of its queries still hold, meets no rows.
        apart = F.when(F.col("is_large"), F.xxhash64("key", "row_block", "query_block")).otherwise(F.col("key"))
        return cut.withColumn("key", apart).withColumn("group", F.pmod(F.shiftright("key", 32), F.lit(groups).cast("long")))

    def codes(vec_id: pa.Array, vector: pa.Array) -> dict:
        parts = [encode(matrix([v])) for v in vector.to_pylist()]
        return {"id": vec_id, "code": [c[0].tobytes() for c, _, _ in parts], "unit": [float(u[0]) for _, u, _ in parts], "error": [float(e[0]) for _, _, e in parts]}

    # Lists come whole from each query; visits are rows only where cells are cut.
    lists = map_arrow(classes.select("vec_id", "vector"), _listed(setting, groups), "group long, id long, keys array<long>")
    if large.count():
        blocks_met = dealt(asked, "query", "row", "inner").groupBy("group", "id").agg(F.collect_list("key").alias("keys"))
        lists = lists.unionByName(blocks_met)
    coded = map_arrow(classes.select("vec_id", "vector"), codes, "id long, code binary, unit double, error double")
    met = (
        dealt(index, "row", "query", "left").select("group", "key", "id", "code", "unit", "error").groupBy("group")
        .cogroup(lists.join(coded, "id").select("group", "id", "keys", "code", "unit", "error").groupBy("group"))
        .applyInPandas(_meet(k + 1), "q long, vec_id long, low double, high double")
    )
    met = materialize(met.groupBy("q", "vec_id").agg(F.max("low").alias("low"), F.min("high").alias("high")))
    by_bound = Window.partitionBy("q").orderBy("high", "vec_id")
    limit = met.withColumn("rank", F.row_number().over(by_bound)).where(F.col("rank") <= k + 1).groupBy("q").agg(F.max("high").alias("limit"))
    pairs = met.join(limit, "q").where("low <= limit").select("q", "vec_id")

    # Exact distances, on the vectors, of the few rows left.
    measured = (
        pairs.join(held.withColumnRenamed("vector", "x"), "vec_id")
        .join(classes.select(F.col("vec_id").alias("q"), F.col("vector").alias("y")), "q")
        .where(F.octet_length("x") == F.octet_length("y"))
    )

    def score(q: pa.Array, vec_id: pa.Array, x: pa.Array, y: pa.Array) -> dict:
        d = [float(np.sqrt(((np.frombuffer(a, np.float64) - np.frombuffer(b, np.float64)) ** 2).sum())) for a, b in zip(x.to_pylist(), y.to_pylist())]
        return {"q": q, "vec_id": vec_id, "score": d}

    scored = map_arrow(measured.select("q", "vec_id", "x", "y"), score, "q long, vec_id long, score double")
    named = classes.select(F.col("vec_id").alias("q"), "vector").join(wanted.withColumnRenamed("vec_id", "query_id"), "vector").select("q", "query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    top = materialize(ranked(scored.join(named, "q")))
    done = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = materialize(wanted.join(done, "vec_id", "left_anti"))
    n_short = short.count()
    if not n_short:
        return top
    # Queries that met fewer than k rows are measured against all rows.
    row_blocks, query_blocks = math.ceil(total / group_rows), math.ceil(n_short / EXACT_QUERIES)

    def blocks(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return side.select(
            F.col("vec_id").alias("id"), F.col("vector").alias("vector"), F.octet_length("vector").alias("size"),
            F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(f"{other}_block"),
        )

    sizes = short.select(F.octet_length("vector").alias("size")).distinct()
    all_rows = blocks(held, "row", row_blocks, "query", query_blocks).join(sizes, "size", "left_semi")
    keys = ("size", "row_block", "query_block")
    exact = (
        all_rows.groupBy(*keys).cogroup(blocks(short, "query", query_blocks, "row", row_blocks).groupBy(*keys))
        .applyInPandas(_measure(k), "query_id long, vec_id long, score double")
    )
    return top.join(done.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*top.columns).unionByName(ranked(exact))
