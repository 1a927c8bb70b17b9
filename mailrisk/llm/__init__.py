"""Operators of a training-data pipeline: dedup, search, tokens, filters, classifiers, packing, media."""
