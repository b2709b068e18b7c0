"""Operators of a training-data pipeline: filters, scans, duplicates, mixing."""
