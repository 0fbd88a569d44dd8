"""Operators for large training-text pipelines, their queries and their reference SQL.

Nothing outside this package imports it, so it can be removed as a whole.
"""
