"""Operators of a training-data pipeline: sharding, de-duplication, scoring, encoding and formatting."""
