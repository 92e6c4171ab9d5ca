"""Queries that bind the operators to the test tables, by name, with their SQL."""

from tracelake.plans import features, featuresets, metadata, signals, streams, timing, trials  # noqa: F401
from tracelake.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
