"""Operators for large training-data pipelines.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries live in :mod:`folioscope.llm.queries`.
"""
