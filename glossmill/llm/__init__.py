"""Operators for preparing training text: sharding, filtering, deduplication, packing.

Nothing else in the library imports this subpackage.
"""
