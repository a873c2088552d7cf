"""Operators for building training corpora: tokenising, search, filtering, deduplication, packing.

Nothing else in the library imports this subpackage.
"""
