"""Operators of a training-data pipeline over text, page and vector tables."""
