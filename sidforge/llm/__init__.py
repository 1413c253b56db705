"""Operators for preparing training data, their queries and the SQL twins.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
