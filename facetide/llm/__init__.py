"""Operators for a training-data corpus: clean, deduplicate, filter, count and pack documents."""
