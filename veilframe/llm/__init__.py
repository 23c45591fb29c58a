"""Operators of a training-data pipeline, each a function from tables to tables."""
