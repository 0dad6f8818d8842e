"""Operators for preparing training data for language models.

Every operator takes and returns DataFrames; the registered queries and their
DuckDB statements are in ``queries``.
"""
