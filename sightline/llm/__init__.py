"""Training-data operators: tokenising, deduplication, classification, packing.

Nothing outside this subpackage imports it; the rest of the library works
without it.
"""
