"""Training-data operators: deduplication, quality, safety, mixing and packing of text tables.

Nothing else in the library imports this subpackage, so it can be removed on its own.
"""
