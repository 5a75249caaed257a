"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it.  ``queries`` holds the registered
``opN_*`` queries; every operator also has a general interface of its own.
"""
