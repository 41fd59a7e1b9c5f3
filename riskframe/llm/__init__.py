"""Operators for training-data pipelines: text quality, duplicates, personal data, mixing, encoding, models."""
