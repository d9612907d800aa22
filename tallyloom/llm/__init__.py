"""Operators for preparing text corpora: deduplication, scoring, packing, archives.

Nothing else in the library imports this subpackage.
"""
