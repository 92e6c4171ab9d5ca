"""How queries are registered: a function of (spark, sf_dir) and, where SQL can
say the same, its text for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, column: str = "ts", out: str = "us") -> DataFrame:
    """Times are read without a zone; microseconds since the epoch in UTC."""
    return df.withColumn(out, F.unix_micros(F.to_timestamp(F.col(column))))


def signed_round(value: Column, digits: int = 6) -> Column:
    """Rounded as SQL rounds: what comes to zero keeps its sign."""
    rounded = F.round(value, digits)
    return F.when(rounded == 0, F.signum(value) * 0.0).otherwise(rounded)


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]
