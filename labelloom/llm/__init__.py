"""Operators of a training-data pipeline: extraction, scoring, deduplication, search and mixing."""
