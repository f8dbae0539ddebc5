"""Lineup analytics on Spark: event logs to segments, ratings and reports."""
