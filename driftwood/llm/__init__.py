"""Operators of a training-data pipeline. Nothing outside of this package imports it."""
