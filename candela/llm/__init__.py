"""Operators of a training-data pipeline: filters, scores, near duplicates, formatting, packing and mixing."""
