"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries with their SQL, the other modules hold one operator each.
"""
