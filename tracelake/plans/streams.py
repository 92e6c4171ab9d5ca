"""Streaming queries over the events file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import decode
from tracelake.plans.base import query, r6, signed_round, table
from tracelake.plans.features import KALMAN_SQL
from tracelake.plans.signals import _HITS
from tracelake.streaming import stateful


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # As a pattern, for the stream source takes a plain path to be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(f"{_HITS} SELECT user_id, event_id, value, idx FROM h WHERE hit")
def stream_refractory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.run_available(stateful.spikes(_stream(spark, sf_dir, "events"), "user_id", "event_id", "value", 100, 5))


@query("""SELECT user_id, event_id, round(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) / 9, 6) AS mav FROM events""")
def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stateful.run_available(stateful.trailing_mean_abs(_stream(spark, sf_dir, "events"), "user_id", "event_id", "value", 9))
    return rows.select("user_id", "event_id", *r6("mav"))


@query("""WITH w AS (SELECT event_type, value, unnest([0, 1]) AS k, epoch_us(ts) // 21600000000 AS b FROM events)
SELECT event_type, (b - k) * 21600 AS start, count(*) AS n, round(avg(abs(value)), 6) AS mean_abs FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").withColumn("at", F.to_timestamp("ts"))
    rows = stateful.run_available(stateful.sliding(events, "at", "value", "event_type", "12 hours", "6 hours"), "complete")
    return rows.select("event_type", F.unix_seconds("start").alias("start"), "n", *r6("mean_abs"))


@query(KALMAN_SQL)
def stream_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lambda df: df.select("vec_id", "label", F.slice("embedding", 1, 2).alias("state"), F.slice("embedding", 9, 2).alias("features"))
    model = decode.train(parts(table(spark, sf_dir, "embeddings")), "label", "vec_id", "state", "features", 2)
    rows = stateful.run_available(stateful.kalman(parts(_stream(spark, sf_dir, "embeddings")), "label", "vec_id", "features", model))
    return rows.select("label", "vec_id", F.transform("predicted", lambda p: signed_round(p)).alias("predicted"))
