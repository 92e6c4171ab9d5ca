"""Feature sets by name, on ticks and with a baseline.

Events are samples (channel: user, order: event id); every third event is the
baseline recording.  Both have ticks at fixed samples, one of them far enough
from the next to meet the cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import kernels
from tracelake.operators import registry
from tracelake.plans import sqltext
from tracelake.plans.base import query, table

TICKS = (1, 6, 11, 15, 20, 25, 34, 38, 43, 60)
BASE_TICKS = (1, 5, 9, 14, 19)
CAP = 6
PARAMS = {"cap": CAP, "refractory": 5, "threshold": -1.0, "step": 3, "length": 10, "every": 4, "levels": 2, "frame": 16}


def _samples(spark: SparkSession, sf_dir: str, baseline: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_id % 3 = 0" if baseline else "true")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return events.select(F.col("user_id").alias("chan"), idx.alias("idx"), "value")


def recording(spark: SparkSession, sf_dir: str, **params) -> registry.Recording:
    ticks = lambda t: spark.createDataFrame([(v,) for v in t], "tick long")
    return registry.Recording(_samples(spark, sf_dir), ticks(TICKS), _samples(spark, sf_dir, True), ticks(BASE_TICKS), params=PARAMS | params)


_SOURCES = """s AS (SELECT user_id AS chan, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, value FROM events),
b AS (SELECT user_id AS chan, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, value FROM events WHERE event_id % 3 = 0)"""


def _chunks(name: str, ticks: tuple[int, ...]) -> str:
    rows = ", ".join(f"({i}, {b - min(b - a, CAP)}, {b})" for i, (a, b) in enumerate(zip(ticks, ticks[1:]), 1))
    return f"{name}(frame, lo, hi) AS (VALUES {rows})"


_FILTERED = f"{_SOURCES}, {sqltext.filtfilt('fs', 's', *kernels.HIGH_PASS)}, {sqltext.filtfilt('fb', 'b', *kernels.HIGH_PASS)}, {_chunks('cs', TICKS)}, {_chunks('cb', BASE_TICKS)}"
_LAST = f"UNION ALL SELECT DISTINCT chan, {len(TICKS)} AS frame, 0.0::DOUBLE AS feature FROM s"


def _rates(name: str, source: str, chunks: str, hits: str) -> str:
    return f"""{name} AS (SELECT chan, frame, sum(coalesce(hits, 0) / 0.033) OVER (PARTITION BY chan ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) / 9 AS f
  FROM (SELECT DISTINCT chan FROM {source}) CROSS JOIN {chunks} LEFT JOIN {hits} USING (chan, frame))"""


_NFR = f"""WITH RECURSIVE {_FILTERED},
ls AS (SELECT chan, -1.0 * stddev_samp(value) AS t FROM fs GROUP BY chan), lb AS (SELECT chan, -1.0 * stddev_samp(value) AS t FROM b GROUP BY chan),
{sqltext.spike_chunks('hs', 'cs', 'fs', 'ls', 5)}, {sqltext.spike_chunks('hb', 'cb', 'fb', 'lb', 5)}, {_rates('rs', 's', 'cs', 'hs')}, {_rates('rb', 'b', 'cb', 'hb')},
m AS (SELECT chan, avg(f) AS base FROM rb GROUP BY chan)
SELECT chan, frame::INT AS frame, round(feature, 6) AS feature FROM (SELECT chan, frame, f - coalesce(base, 0) AS feature FROM rs LEFT JOIN m USING (chan) {_LAST})"""


def _rings(name: str, source: str, filtered: str, chunks: str) -> str:
    return f"""{name}_c AS (SELECT u.chan, c.frame, coalesce(list(f.value ORDER BY f.idx) FILTER (WHERE f.idx IS NOT NULL), []) AS part
  FROM (SELECT DISTINCT chan FROM {source}) u CROSS JOIN {chunks} c LEFT JOIN {filtered} f ON f.chan = u.chan AND f.idx >= c.lo AND f.idx < c.hi GROUP BY ALL),
{name}_r AS (
  SELECT chan, 0 AS frame, list_transform(range(0, 9), lambda i: 0.0::DOUBLE) AS ring FROM (SELECT DISTINCT chan FROM {source})
  UNION ALL SELECT c.chan, c.frame, list_concat(c.part, r.ring[1:greatest(len(r.ring) - len(c.part), 0)]) FROM {name}_r r JOIN {name}_c c ON c.chan = r.chan AND c.frame = r.frame + 1),
{name} AS (SELECT chan, frame, list_avg(list_transform(ring, lambda v: abs(v))) AS f FROM {name}_r WHERE frame > 0)"""


_MAV = f"""WITH RECURSIVE {_FILTERED}, {_rings('gs', 's', 'fs', 'cs')}, {_rings('gb', 'b', 'fb', 'cb')}, m AS (SELECT chan, avg(f) AS base FROM gb GROUP BY chan)
SELECT chan, frame::INT AS frame, round(feature, 6) AS feature FROM (SELECT chan, frame, f - coalesce(base, 0) AS feature FROM gs LEFT JOIN m USING (chan) {_LAST})"""


def _powers(first: str, source: str) -> str:
    return f"""WITH RECURSIVE {_SOURCES}{first}, {sqltext.filtfilt('fs', source, *kernels.BAND_PASS)},
d AS (SELECT chan, (idx - 1) // 3 + 1 AS j, abs(value) AS v FROM fs WHERE (idx - 1) % 3 = 0),
t AS (SELECT chan, j, sum(v) OVER (PARTITION BY chan ORDER BY j ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10 AS f FROM d),
k AS (SELECT chan, (j - 1) // 4 + 1 AS frame, f FROM t WHERE (j - 1) % 4 = 0), n AS (SELECT chan, max(frame) AS n FROM k GROUP BY chan)
SELECT n.chan, g::INT AS frame, round(k.f, 6) AS feature FROM n CROSS JOIN generate_series(1, {len(TICKS)}) x(g) JOIN k ON k.chan = n.chan AND k.frame = least(g, n)"""


_CAR = ", c AS (SELECT chan, idx, value - avg(value) OVER (PARTITION BY idx) AS value FROM s)"


def _wavelets(wavelet: str) -> str:
    ticks = ", ".join(f"({i}, {t})" for i, t in enumerate(TICKS, 1))
    return f"""WITH {_SOURCES}, lists AS (SELECT chan, list(value ORDER BY idx) AS x FROM b GROUP BY chan), {sqltext.wavelet_limits('lim', 'lists', 'chan', wavelet, 2)},
own AS (SELECT chan, list(value ORDER BY idx) AS x FROM s GROUP BY chan), {sqltext.wavelet_limits('olim', 'own', 'chan', wavelet, 2)},
limits AS (SELECT o.chan, o.level, coalesce(l.threshold, o.threshold) AS threshold FROM olim o LEFT JOIN lim l USING (chan, level)),
ticks(frame, tick) AS (VALUES {ticks}), n AS (SELECT chan, count(*) AS n FROM s GROUP BY chan),
frames AS (SELECT n.chan, t.frame, list(coalesce(s.value, 0) ORDER BY k) AS x FROM n CROSS JOIN ticks t CROSS JOIN generate_series(0, 15) g(k) LEFT JOIN s ON s.chan = n.chan AND s.idx = least(t.tick, n.n) - 15 + k GROUP BY n.chan, t.frame),
{sqltext.wavelet_levels('w', 'frames', 'chan, frame', wavelet, 2)}
SELECT chan, frame::INT AS frame, level::INT AS level, round(energy, 6) AS feature FROM ({sqltext.energies('w', 'limits', 'chan, frame', 'chan', 2)})"""


_SQL = {
    "NFR": _NFR, "MAV": _MAV, "SBP": _powers("", "s"), "SBP-CAR": _powers(_CAR, "c"), "DWT-DB4": _wavelets("db4"), "DWT-DB1": _wavelets("db1"),
}


def _features(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return registry.extract(name, recording(spark, sf_dir)).withColumn("feature", F.round("feature", 6))

    run.__name__ = "features_" + name.lower().replace("-", "_")
    return run


for _name in registry.FEATURE_SETS:
    query(_SQL.get(_name))(_features(_name))


@query(f"""{_NFR.replace('SELECT chan, frame::INT AS frame, round(feature, 6) AS feature FROM (', 'SELECT frame::INT AS frame, list(round(feature, 6) ORDER BY chan) AS features FROM (')} GROUP BY frame""")
def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.wide(registry.extract("NFR", recording(spark, sf_dir)), [])
    return rows.select("frame", F.transform("features", lambda v: F.round(v, 6)).alias("features"))


@query(f"SELECT user_id AS chan, frame::INT AS frame, true AS timed FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN generate_series(1, {len(TICKS)}) g(frame)")
def computation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.extract("NFR", recording(spark, sf_dir, timed=True))
    return rows.select("chan", "frame", (F.col("seconds") >= 0).alias("timed"))
