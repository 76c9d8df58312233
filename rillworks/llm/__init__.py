"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it.  Every operator is a module with a
general interface; `queries` holds the thin contract queries over them.
"""
