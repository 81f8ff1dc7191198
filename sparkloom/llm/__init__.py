"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. Each module holds one operator with a general
interface; ``queries`` registers the thin ``opN_<name>`` queries over the driver's tables.
"""
