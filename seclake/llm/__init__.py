"""Operators for training-data pipelines: filters, deduplication, mixing, search and web archives."""
