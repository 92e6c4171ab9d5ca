"""Signal queries: events are samples (channel: user, order: event id)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import kernels
from tracelake.operators import framing
from tracelake.plans import sqltext
from tracelake.plans.base import micros, query, r6, table

_SAMPLES = "s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events)"
_HITS = f"""WITH RECURSIVE {_SAMPLES},
h AS (
  SELECT user_id, idx, event_id, value, CASE WHEN value >= 100 THEN idx + 5 ELSE 0 END AS free, value >= 100 AS hit FROM s WHERE idx = 1
  UNION ALL
  SELECT s.user_id, s.idx, s.event_id, s.value, CASE WHEN s.value >= 100 AND s.idx >= h.free THEN s.idx + 5 ELSE h.free END,
    s.value >= 100 AND s.idx >= h.free
  FROM h JOIN s ON s.user_id = h.user_id AND s.idx = h.idx + 1)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value")


@query("""SELECT user_id, event_id, round(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) / 9, 6) AS mav FROM events""")
def mav_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framing.trailing_mean_abs(_events(spark, sf_dir), "user_id", ["event_id"], "value", 9, "mav")
    return rows.select("user_id", "event_id", *r6("mav"))


@query(f"""WITH {_SAMPLES}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS j FROM s WHERE (idx - 1) % 3 = 0),
f AS (SELECT *, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY j ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10 AS power FROM d)
SELECT user_id, event_id, round(power, 6) AS power FROM f WHERE (j - 1) % 4 = 0""")
def sbp_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = framing.decimate(framing.numbered(_events(spark, sf_dir), "user_id", ["event_id"]), "idx", 3)
    rows = framing.trailing_mean_abs(framing.numbered(kept, "user_id", ["idx"], "j"), "user_id", ["j"], "value", 10, "power")
    return framing.decimate(rows, "j", 4).select("user_id", "event_id", *r6("power"))


@query(f"{_HITS} SELECT user_id, event_id, value, idx FROM h WHERE hit")
def spike_refractory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.detect_spikes(_events(spark, sf_dir), "user_id", "event_id", "value", 100, 5)


@query(f"""{_HITS},
c AS (SELECT user_id, (idx - 1) // 4 AS frame, count(*) FILTER (WHERE hit) / 0.033 AS rate FROM h GROUP BY ALL),
t AS (SELECT user_id, frame, sum(rate) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) / 9 AS f FROM c)
SELECT user_id, frame, round(f - avg(f) OVER (PARTITION BY user_id), 6) AS feature FROM t""")
def spike_rate_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.floor((F.col("idx") - 1) / 4).alias("frame")
    hits = framing.detect_spikes(_events(spark, sf_dir), "user_id", "event_id", "value", 100, 5).select("user_id", frame)
    frames = framing.numbered(_events(spark, sf_dir), "user_id", ["event_id"]).select("user_id", frame).distinct()
    return framing.firing_rate(hits, frames, "user_id", "frame", "frame", 0.033, 9).select("user_id", "frame", *r6("feature"))


@query(f"""WITH RECURSIVE {_SAMPLES},
f AS (
  SELECT user_id, idx, event_id, 0.2 * value AS y, 0.3 * value + 0.5 * 0.2 * value AS z FROM s WHERE idx = 1
  UNION ALL
  SELECT s.user_id, s.idx, s.event_id, 0.2 * s.value + f.z, 0.3 * s.value + 0.5 * (0.2 * s.value + f.z) FROM f JOIN s ON s.user_id = f.user_id AND s.idx = f.idx + 1)
SELECT user_id, event_id, round(y, 6) AS filtered FROM f""")
def iir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framing.filtered(_events(spark, sf_dir), "user_id", "event_id", "value", np.array([0.2, 0.3]), np.array([1, -0.5]), False)
    return rows.select("user_id", "event_id", *r6("filtered"))


_ROWS = "s AS (SELECT user_id AS chan, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events)"


@query(f"WITH RECURSIVE {_ROWS}, {sqltext.filtfilt('f', 's', *kernels.HIGH_PASS)} SELECT chan AS user_id, event_id, round(f.value, 6) AS filtered FROM f JOIN s USING (chan, idx)")
def filtfilt_high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framing.filtered(_events(spark, sf_dir), "user_id", "event_id", "value", *kernels.HIGH_PASS, True)
    return rows.select("user_id", "event_id", *r6("filtered"))


@query(f"""WITH RECURSIVE {_ROWS}, {sqltext.filtfilt('f', 's', *kernels.BAND_PASS)}
SELECT chan AS user_id, event_id, round(sum(abs(f.value)) OVER (PARTITION BY chan ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10, 6) AS power FROM f JOIN s USING (chan, idx)""")
def filtfilt_band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framing.filtered(_events(spark, sf_dir), "user_id", "event_id", "value", *kernels.BAND_PASS, True)
    return framing.trailing_mean_abs(rows, "user_id", ["event_id"], "filtered", 10, "power").select("user_id", "event_id", *r6("power"))


@query(f"""WITH {_SAMPLES},
e AS (SELECT user_id, idx AS frame_end FROM s WHERE (idx - 1) % 16 = 0),
w AS (SELECT e.user_id, e.frame_end, g.k, coalesce(s.value, 0) AS v FROM e CROSS JOIN generate_series(0, 7) g(k) LEFT JOIN s ON s.user_id = e.user_id AND s.idx = e.frame_end - 7 + g.k),
p AS (SELECT user_id, frame_end, k // 2 AS j, max(CASE WHEN k % 2 = 0 THEN v END) AS a, max(CASE WHEN k % 2 = 1 THEN v END) AS b FROM w GROUP BY ALL),
q AS (SELECT user_id, frame_end, j // 2 AS i, max(CASE WHEN j % 2 = 0 THEN (a + b) / sqrt(2.0) END) AS a, max(CASE WHEN j % 2 = 1 THEN (a + b) / sqrt(2.0) END) AS b FROM p GROUP BY ALL)
SELECT user_id, ((frame_end - 1) // 16 + 1)::INT AS frame, 1 AS level, round(sum((a - b) * (a - b) / 2), 6) AS energy FROM p GROUP BY user_id, frame_end
UNION ALL
SELECT user_id, ((frame_end - 1) // 16 + 1)::INT, 2, round(sum((a - b) * (a - b) / 2), 6) FROM q GROUP BY user_id, frame_end""")
def dwt_energy_db1(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    limits = events.select("user_id").distinct().withColumn("thresholds", F.array(F.lit(-1.0), F.lit(-1.0)))
    rows = framing.dwt_energies(events, "user_id", "event_id", "value", limits, frame=8, step=16, wavelet="db1")
    return rows.withColumn("energy", F.round("energy", 6))


_LISTS = "lists AS (SELECT user_id, list(value ORDER BY event_id) AS x FROM events GROUP BY user_id)"


@query(f"""WITH {_SAMPLES}, {_LISTS}, {sqltext.wavelet_limits('lim', 'lists', 'user_id', 'db4', 3)},
e AS (SELECT user_id, idx AS frame_end FROM s WHERE (idx - 1) % 16 = 0),
frames AS (SELECT e.user_id, (e.frame_end - 1) // 16 + 1 AS frame, list(coalesce(s.value, 0) ORDER BY g.k) AS x FROM e CROSS JOIN generate_series(0, 31) g(k) LEFT JOIN s ON s.user_id = e.user_id AND s.idx = e.frame_end - 31 + g.k GROUP BY ALL),
{sqltext.wavelet_levels('w', 'frames', 'user_id, frame', 'db4', 3)}
SELECT user_id, frame::INT AS frame, level::INT AS level, round(energy, 6) AS energy FROM ({sqltext.energies('w', 'lim', 'user_id, frame', 'user_id', 3)})""")
def dwt_energy_db4(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    limits = framing.dwt_limits(events, "user_id", "event_id", "value", levels=3)
    rows = framing.dwt_energies(events, "user_id", "event_id", "value", limits, frame=32, step=16)
    return rows.withColumn("energy", F.round("energy", 6))


@query(f"WITH {_LISTS}, {sqltext.wavelet_limits('lim', 'lists', 'user_id', 'db4', 3)} SELECT user_id, level::INT AS level, round(threshold, 6) AS threshold FROM lim")
def dwt_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framing.dwt_limits(_events(spark, sf_dir), "user_id", "event_id", "value", levels=3)
    return rows.select("user_id", F.posexplode("thresholds").alias("level", "threshold")).select("user_id", (F.col("level") + 1).alias("level"), *r6("threshold"))


@query("SELECT user_id, round(median(abs(value)) / 0.6745, 6) AS noise FROM events GROUP BY user_id")
def robust_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.robust_noise(_events(spark, sf_dir), "user_id", "value").select("user_id", *r6("noise"))


@query("SELECT user_id, round(stddev_samp(value) * -5, 6) AS threshold FROM events GROUP BY user_id")
def std_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.thresholds(_events(spark, sf_dir), "user_id", "value").select("user_id", *r6("threshold"))


@query("""WITH t AS (SELECT user_id, event_id, (ceil((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0) + 1)::BIGINT AS tick FROM events)
SELECT user_id, event_id, tick, least(coalesce(lead(tick) OVER (PARTITION BY user_id ORDER BY event_id) - tick, 0), 1110) AS step FROM t""")
def tick_diff_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = micros(table(spark, sf_dir, "events"))
    rows = framing.tick_steps(events, "user_id", F.col("us") / 1000000.0, ["event_id"])
    return rows.select("user_id", "event_id", "tick", "step")
