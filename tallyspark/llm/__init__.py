"""Operators for preparing training text: scoring, filtering, deduplication, mixing and packing.

Every operator takes and returns DataFrames. Nothing else in the library imports this package.
"""
