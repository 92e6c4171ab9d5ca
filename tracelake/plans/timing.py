"""Alignment and interval queries.

Frames of a user are its views, sorted events the others; orders serve as
ranges, and purchases open an interval of two days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import align, islands
from tracelake.plans.base import micros, query, table

_BASE = """f AS (SELECT user_id, epoch_us(ts) AS frame_us FROM events WHERE event_type = 'view'),
e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
i AS (SELECT user_id, event_id AS trial_id, epoch_us(ts) AS start_us, epoch_us(ts) + 172800000000 AS stop_us FROM events WHERE event_type = 'purchase')"""
_DAY = 86_400_000_000


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micros(table(spark, sf_dir, "events")).where("event_type = 'view'").select("user_id", F.col("us").alias("frame_us"))


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micros(table(spark, sf_dir, "events")).where("event_type = 'click'").select("user_id", "event_id", "us")


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = micros(table(spark, sf_dir, "events")).where("event_type = 'purchase'")
    return bought.select("user_id", F.col("event_id").alias("trial_id"), F.col("us").alias("start_us"), (F.col("us") + 2 * _DAY).alias("stop_us"))


_NEAREST = f"""WITH {_BASE},
b AS (SELECT e.*, (SELECT max(frame_us) FROM f WHERE f.user_id = e.user_id AND frame_us <= us) AS back,
  (SELECT min(frame_us) FROM f WHERE f.user_id = e.user_id AND frame_us >= us) AS ahead FROM e)"""


@query(f"""{_NEAREST} SELECT user_id, event_id, us, CASE WHEN back IS NULL OR ahead IS NULL THEN NULL WHEN us - back <= ahead - us THEN back ELSE ahead END AS frame_us FROM b""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nearest(_clicks(spark, sf_dir), _frames(spark, sf_dir), "user_id", "us", "frame_us", "frame_us")


@query(f"""{_NEAREST} SELECT DISTINCT user_id, CASE WHEN us - back <= ahead - us THEN back ELSE ahead END AS frame_us FROM b WHERE back IS NOT NULL AND ahead IS NOT NULL""")
def asof_nearest_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nearest_frames(_clicks(spark, sf_dir), _frames(spark, sf_dir), "user_id", "us", "frame_us")


@query(f"""WITH {_BASE} SELECT e.user_id, e.event_id, e.us, count(f.frame_us) AS idx FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.frame_us < e.us GROUP BY ALL""")
def asof_left_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.left_rank(_clicks(spark, sf_dir), _frames(spark, sf_dir), "user_id", "us", "frame_us")


@query(f"WITH {_BASE} SELECT f.user_id, frame_us, trial_id, start_us, stop_us FROM f JOIN i ON f.user_id = i.user_id AND frame_us BETWEEN start_us AND stop_us")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.in_intervals(_frames(spark, sf_dir), _trials(spark, sf_dir), "user_id", "frame_us", "start_us", "stop_us", step=_DAY)


@query(f"WITH {_BASE} SELECT user_id, frame_us FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE f.user_id = i.user_id AND frame_us BETWEEN start_us AND stop_us)")
def baseline_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.outside_intervals(_frames(spark, sf_dir), _trials(spark, sf_dir), "user_id", "frame_us", "start_us", "stop_us")


@query("SELECT o_orderkey, unnest(generate_series(o_orderkey, o_orderkey + o_custkey % 5 - 1)) AS idx FROM orders WHERE o_custkey % 5 > 0")
def sequence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("stop", F.col("o_orderkey") + F.col("o_custkey") % 5)
    return align.expand(orders, "o_orderkey", "stop").select("o_orderkey", "idx")


@query("""SELECT user_id, (min(epoch_us(ts)) + user_id * 10)::BIGINT AS first_sample, (max(epoch_us(ts)) + user_id * 10)::BIGINT AS last_sample FROM events GROUP BY user_id""")
def clock_offset_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = micros(table(spark, sf_dir, "events")).withColumn("offset", F.col("user_id") * 10)
    return align.clock_range(rows, "user_id", "us", "offset")


_RUNS = """n AS (SELECT user_id, event_id, value, value > 50 AS act, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row FROM events),
g AS (SELECT *, row - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM n WHERE act),
r AS (SELECT user_id, min(row) AS start, max(row) AS stop, count(*) AS length, row_number() OVER (PARTITION BY user_id ORDER BY min(row)) AS run FROM g GROUP BY user_id, island)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.runs(_samples(spark, sf_dir), "user_id", "event_id", F.col("value") > 50)


@query(f"WITH {_RUNS} SELECT user_id, run::INT AS run, start::INT AS start, stop::INT AS stop, length FROM r")
def activity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(f"""WITH {_RUNS}, k AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) - stop AS gap FROM r)
SELECT user_id, run::INT AS run, start::INT AS start, start + round(avg(length) OVER (PARTITION BY user_id))::BIGINT - 1 AS stop FROM k WHERE coalesce(gap <= 4, true)""")
def edge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.sized_windows(_runs(spark, sf_dir), "user_id", big_gap=4)


@query(f"""WITH {_RUNS}, c AS (SELECT user_id, row, row_number() OVER (PARTITION BY user_id ORDER BY row) AS relative_row FROM n WHERE value > 20)
SELECT r.user_id, run::INT AS run, start::INT AS start, stop::INT AS stop, length, min(relative_row)::INT AS relative_start, max(relative_row)::INT AS relative_stop
FROM r JOIN c ON c.user_id = r.user_id AND c.row BETWEEN start AND stop GROUP BY ALL""")
def mask_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = islands.compacted(_samples(spark, sf_dir), "user_id", "event_id", F.col("value") > 20)
    return islands.mask_trials(_runs(spark, sf_dir), kept, "user_id")


@query(f"""WITH {_RUNS}, z AS (SELECT *, sum(value - 80) OVER (PARTITION BY user_id, island) AS total FROM g)
SELECT n.user_id, n.event_id, coalesce(z.total > 0, false) AS mask FROM n LEFT JOIN z ON z.user_id = n.user_id AND z.event_id = n.event_id""")
def mask_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("kin", F.col("value") - 80)
    return islands.cleared(rows, "user_id", "event_id", "kin", F.col("value") > 50, 1).select("user_id", "event_id", "mask")


_SIDES = """WITH n AS (SELECT user_id, sign(value - 50)::INT AS side, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row FROM events),
g AS (SELECT *, row - row_number() OVER (PARTITION BY user_id, side ORDER BY row) AS island FROM n WHERE side <> 0),
r AS (SELECT user_id, side, min(row) AS start, max(row) AS stop, count(*) AS length, row_number() OVER (PARTITION BY user_id, side ORDER BY min(row)) AS run FROM g GROUP BY user_id, side, island),
k AS (SELECT *, lead(start) OVER (PARTITION BY user_id, side ORDER BY start) - stop AS gap FROM r), d AS (SELECT * FROM k WHERE coalesce(gap <= 6, true)),
a AS (SELECT user_id, coalesce(round(avg(length) FILTER (WHERE side = 1)), round(avg(length) FILTER (WHERE side = -1)))::BIGINT AS size FROM d GROUP BY user_id)"""


@query(f"{_SIDES} SELECT d.user_id, CASE WHEN side = 1 THEN 'pos' ELSE 'neg' END AS side, run::INT AS run, start::INT AS start, start + size - 1 AS stop FROM d JOIN a USING (user_id)")
def movement_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("kin", F.col("value") - 50)
    return islands.movement_windows(rows, "user_id", "event_id", "kin", big_gap=6)


@query("""WITH n AS (SELECT user_id, (value > 50)::INT AS act, row_number() OVER w AS row, lag((value > 50)::INT) OVER w AS before, lead((value > 50)::INT) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT user_id, greatest(row - 1, 1) AS start, row_number() OVER (PARTITION BY user_id ORDER BY row) AS w FROM n WHERE act = 1 AND coalesce(before, 0) = 0),
z AS (SELECT user_id, row AS stop, row_number() OVER (PARTITION BY user_id ORDER BY row) AS w FROM n WHERE act = 1 AND coalesce(after, 0) = 0)
SELECT user_id, w::INT AS window, start::INT AS start, stop::INT AS stop FROM a JOIN z USING (user_id, w)""")
def movement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.edges(_samples(spark, sf_dir), "user_id", "event_id", F.col("value") > 50)


@query(f"""WITH {_RUNS}, c AS (SELECT user_id, row + 1 AS row, row_number() OVER (PARTITION BY user_id ORDER BY row) AS relative_row FROM n WHERE value > 20)
SELECT r.user_id, run::INT AS run, start::INT AS start, stop::INT AS stop, length, min(relative_row)::INT AS relative_start, max(relative_row)::INT AS relative_stop
FROM r JOIN c ON c.user_id = r.user_id AND c.row BETWEEN start AND stop GROUP BY ALL""")
def mask_compact_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = islands.compacted(_samples(spark, sf_dir), "user_id", "event_id", F.col("value") > 20)
    return islands.mask_trials(_runs(spark, sf_dir), kept, "user_id", shift=1)
