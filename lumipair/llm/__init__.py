"""Operators for training-data pipelines: tokens, packing, classifiers, quality rules, deduplication, personal data."""
