"""Operators of a training-data pipeline: filters, near duplicates, decontamination, tokens, placement and search."""
