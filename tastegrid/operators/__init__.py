"""Encoding, splits, models, evaluation and serving."""
