"""Spark-first analytics for multichannel time-series recordings and their metadata."""
