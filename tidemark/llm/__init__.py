"""Operators of a training-data pipeline: filters, duplicates, models and formats."""
