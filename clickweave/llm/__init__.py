"""Operators for training-data pipelines: cleaning, deduplication, packing."""
