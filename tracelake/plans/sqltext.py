"""SQL of sequential operators, written out for DuckDB: recursive filters,
wavelet levels, spike chunks and small Kalman models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tracelake.functions import kernels


def number(x: float) -> str:
    return f"'{float(x)!r}'::DOUBLE"


def filtfilt(name: str, source: str, b: Sequence[float], a: Sequence[float]) -> str:
    """CTEs that end in ``name`` (chan, idx, value): the zero-phase filter of
    ``source`` (chan, idx, value); channels too short for it are left out."""
    b, a = kernels._padded(np.asarray(b, float), np.asarray(a, float))
    m = len(b) - 1
    edge = 3 * m
    k = np.eye(m)
    k[:, 0] += a[1:]
    k[np.arange(m - 1), np.arange(1, m)] -= 1
    start = np.linalg.solve(k, b[1:] - a[1:] * b[0])

    def step(v: str, z: Sequence[str]) -> str:
        y = f"({number(b[0])} * {v} + {z[0]})"
        states = [f"{z[i] if i < m else '0'} + {number(b[i])} * {v} - {number(a[i])} * {y} AS z{i}" for i in range(1, m + 1)]
        return f"{y} AS y, " + ", ".join(states)

    first = lambda v: step(v, [f"{number(s)} * {v}" for s in start])
    later = step("e.v", [f"p.z{i}" for i in range(1, m + 1)])
    return f"""{name}_n AS (SELECT chan, count(*) AS n FROM {source} GROUP BY chan HAVING count(*) > {edge}),
{name}_e AS (
  SELECT s.chan, s.idx + {edge} AS j, s.value AS v FROM {source} s JOIN {name}_n USING (chan)
  UNION ALL SELECT s.chan, {edge} + 2 - s.idx, 2 * o.value - s.value FROM {source} s JOIN {name}_n USING (chan) JOIN {source} o ON o.chan = s.chan AND o.idx = 1 WHERE s.idx BETWEEN 2 AND {edge} + 1
  UNION ALL SELECT s.chan, {edge} + 2 * n - s.idx, 2 * o.value - s.value FROM {source} s JOIN {name}_n USING (chan) JOIN {source} o ON o.chan = s.chan AND o.idx = n WHERE s.idx BETWEEN n - {edge} AND n - 1),
{name}_f AS (
  SELECT e.chan, e.j, {first('e.v')} FROM {name}_e e WHERE e.j = 1
  UNION ALL SELECT e.chan, e.j, {later} FROM {name}_f p JOIN {name}_e e ON e.chan = p.chan AND e.j = p.j + 1),
{name}_g AS (SELECT f.chan, f.j, f.y AS v, n + {2 * edge} AS last FROM {name}_f f JOIN {name}_n USING (chan)),
{name}_h AS (
  SELECT e.chan, e.j, {first('e.v')} FROM {name}_g e WHERE e.j = e.last
  UNION ALL SELECT e.chan, e.j, {later} FROM {name}_h p JOIN {name}_g e ON e.chan = p.chan AND e.j = p.j - 1),
{name} AS (SELECT h.chan, h.j - {edge} AS idx, h.y AS value FROM {name}_h h JOIN {name}_n USING (chan) WHERE h.j BETWEEN {edge} + 1 AND {edge} + n)"""


def wavelet_levels(name: str, source: str, keys: str, wavelet: str, levels: int) -> str:
    """CTEs that end in ``name`` (keys, d1, d2, ...): details by level of the
    lists x of ``source``."""
    low = kernels.WAVELETS[wavelet][::-1]
    taps = len(low)
    high = low[::-1] * np.where(np.arange(taps) % 2 == 0, -1, 1)

    def level(weights: np.ndarray) -> str:
        at = f"((t.i * 2 - k + 1) % (2 * len(x)) + 2 * len(x)) % (2 * len(x))"  # noqa: F541
        at = at.replace("t.i", "i")
        place = f"(CASE WHEN {at} < len(x) THEN {at} ELSE 2 * len(x) - 1 - {at} END)"
        listed = "[" + ", ".join(map(number, weights)) + "]"
        return f"list_transform(range(0, (len(x) + {taps - 1}) // 2), lambda i: list_sum(list_transform(range(0, {taps}), lambda k: {listed}[k + 1] * x[{place} + 1])))"

    parts, before = [], source
    for n in range(1, levels + 1):
        kept = "".join(f", d{i}" for i in range(1, n))
        parts.append(f"{name}_{n} AS (SELECT {keys}{kept}, {level(high)} AS d{n}, {level(low)} AS x FROM {before})")
        before = f"{name}_{n}"
    return ", ".join([*parts, f"{name} AS (SELECT {keys}, {', '.join(f'd{i}' for i in range(1, levels + 1))} FROM {before})"])


def wavelet_limits(name: str, source: str, keys: str, wavelet: str, levels: int) -> str:
    """CTEs that end in ``name`` (keys, level, threshold) of lists x in ``source``."""
    scale = lambda n: "1" if n == 1 else f"sqrt({levels}.0)" if n == levels else f"ln({n + 1}.0)"
    rows = " UNION ALL ".join(
        f"SELECT {keys}, {n} AS level, list_aggregate(list_transform(d{n}, lambda v: abs(v)), 'median') / 0.6745 * sqrt(ln(size)) / {scale(n)} AS threshold FROM {name}_w JOIN {name}_s USING ({keys})"
        for n in range(1, levels + 1)
    )
    return f"{name}_s AS (SELECT {keys}, len(x) AS size FROM {source}), {wavelet_levels(name + '_w', source, keys, wavelet, levels)}, {name} AS ({rows})"


def energies(details: str, limits: str, keys: str, by: str, levels: int) -> str:
    """A query (keys, level, energy) of the details by level over their limits,
    which are joined by ``by``."""
    return " UNION ALL ".join(
        f"SELECT {keys}, {n} AS level, coalesce(list_sum(list_transform(list_filter(d{n}, lambda v: abs(v) > threshold), lambda v: v * v)), 0) AS energy "
        f"FROM {details} JOIN {limits} USING ({by}) WHERE level = {n}"
        for n in range(1, levels + 1)
    )


def spike_chunks(name: str, chunks: str, samples: str, limit: str, refractory: int) -> str:
    """CTEs that end in ``name`` (chan, frame, hits): hits in the chunks (frame, lo,
    hi: one-based samples, hi not included) at or below ``limit`` (chan, t)."""
    return f"""{name}_q AS (
  SELECT s.chan, c.frame, s.idx - c.lo AS p, count(*) OVER (PARTITION BY s.chan, c.frame) AS size, t <> 0 AND CASE WHEN t < 0 THEN s.value <= t ELSE s.value >= t END AS high,
    row_number() OVER (PARTITION BY s.chan ORDER BY c.frame, s.idx) AS r
  FROM {samples} s JOIN {chunks} c ON s.idx >= c.lo AND s.idx < c.hi JOIN {limit} USING (chan)),
{name}_h AS (
  SELECT chan, r, frame, size, CASE WHEN high THEN p + {refractory} ELSE 0 END AS free, high AS had, high AS hit FROM {name}_q WHERE r = 1
  UNION ALL
  SELECT chan, r, frame, size, CASE WHEN high AND p >= w THEN p + {refractory} ELSE w END, (p > 0 AND had) OR (high AND p >= w), high AND p >= w FROM (
    SELECT q.*, h.had, CASE WHEN q.p > 0 THEN h.free WHEN h.had THEN greatest(0, h.free - h.size) ELSE 0 END AS w FROM {name}_h h JOIN {name}_q q ON q.chan = h.chan AND q.r = h.r + 1)),
{name} AS (SELECT chan, frame, count(*) FILTER (WHERE hit) AS hits FROM {name}_h GROUP BY ALL)"""


def _cells(out: str, f) -> str:
    return ", ".join(f"{f(i, j)} AS {out}{i}{j}" for i in (1, 2) for j in (1, 2))


def _dot(left, right) -> str:
    return "(" + " + ".join(f"{left(k)} * {right(k)}" for k in (1, 2)) + ")"


def _inverse(out: str, m: str) -> str:
    det = f"({m}11 * {m}22 - {m}12 * {m}21)"
    return f"{m}22 / {det} AS {out}11, -{m}12 / {det} AS {out}12, -{m}21 / {det} AS {out}21, {m}11 / {det} AS {out}22"


def kalman_model(frames: str, by: str, order: str) -> str:
    """CTEs that end in ``m``, one row: the model (a, w, h, q) of two states x1, x2
    and two features z1, z2 of ``frames``."""
    total = lambda out, left, right: _cells(out, lambda i, j: f"sum({left}{i} * {right}{j})")
    return f"""m1 AS (SELECT *, lead(x1) OVER w AS n1, lead(x2) OVER w AS n2 FROM {frames} WINDOW w AS (PARTITION BY {by} ORDER BY {order})),
m2 AS (SELECT count(*) AS m, {total('xx', 'x', 'x')}, {total('xz', 'x', 'z')}, {total('zz', 'z', 'z')} FROM m1),
m3 AS (SELECT {total('p', 'x', 'x')}, {total('c', 'x', 'n')}, {total('o', 'n', 'n')} FROM m1 WHERE n1 IS NOT NULL),
m4 AS (SELECT *, {_inverse('u', 'xx')}, {_inverse('v', 'p')} FROM m2 CROSS JOIN m3),
m5 AS (SELECT *, {_cells('a', lambda i, j: _dot(lambda k: f'c{k}{i}', lambda k: f'v{k}{j}'))}, {_cells('h', lambda i, j: _dot(lambda k: f'xz{k}{i}', lambda k: f'u{k}{j}'))} FROM m4),
m AS (SELECT *, {_cells('w', lambda i, j: f"(o{i}{j} - {_dot(lambda k: f'a{i}{k}', lambda k: f'c{k}{j}')}) / (m - 1)")},
  {_cells('q', lambda i, j: f"(zz{i}{j} - {_dot(lambda k: f'h{i}{k}', lambda k: f'xz{k}{j}')}) / m")} FROM m5)"""


def kalman_steps(frames: str, by: str, order: str) -> str:
    """CTEs that end in ``k`` (by, order, x1, x2): decoded states, clipped to 1."""
    clip = lambda i: f"greatest(-1.0, least(1.0, y{i} + {_dot(lambda k: f'g{i}{k}', lambda k: f'e{k}')})) AS x{i}"
    return f"""{kalman_model(frames, by, order)}, r AS (SELECT {by}, {order}, z1, z2, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS row FROM {frames}),
k AS (
  SELECT {by}, {order}, row, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p21, 0.0::DOUBLE AS p22 FROM r WHERE row = 1
  UNION ALL
  SELECT {by}, {order}, row, {clip(1)}, {clip(2)}, {', '.join(f"d{i}{j} - {_dot(lambda k: f't{i}{k}', lambda k: f'd{k}{j}')}" for i in (1, 2) for j in (1, 2))} FROM (
    SELECT *, {_cells('t', lambda i, j: _dot(lambda k: f'g{i}{k}', lambda k: f'h{k}{j}'))}, z1 - h11 * y1 - h12 * y2 AS e1, z2 - h21 * y1 - h22 * y2 AS e2 FROM (
      SELECT *, {_cells('g', lambda i, j: _dot(lambda k: f'f{i}{k}', lambda k: f'l{k}{j}'))} FROM (
        SELECT *, {_inverse('l', 's')} FROM (
          SELECT *, {_cells('s', lambda i, j: _dot(lambda k: f'h{i}{k}', lambda k: f'f{k}{j}') + f' + q{i}{j}')} FROM (
            SELECT *, {_cells('f', lambda i, j: _dot(lambda k: f'd{i}{k}', lambda k: f'h{j}{k}'))} FROM (
              SELECT *, {_cells('d', lambda i, j: _dot(lambda k: f'b{i}{k}', lambda k: f'a{j}{k}') + f' + w{i}{j}')} FROM (
                SELECT r.*, {', '.join(f'm.{n}{i}{j}' for n in 'ahwq' for i in (1, 2) for j in (1, 2))}, a11 * k.x1 + a12 * k.x2 AS y1, a21 * k.x1 + a22 * k.x2 AS y2,
                  {_cells('b', lambda i, j: _dot(lambda n: f'm.a{i}{n}', lambda n: f'k.p{n}{j}'))}
                FROM k JOIN r ON r.{by} = k.{by} AND r.row = k.row + 1 CROSS JOIN m))))))))"""
