"""Nimbara: station time-series analytics and text operators on Spark."""
