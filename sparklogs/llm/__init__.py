"""Operators of a training-data pipeline: scoring, deduplication, packing and mixing of text."""
