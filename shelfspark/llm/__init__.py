"""Training-data operators: token counts, filters, deduplication, formatting and packing.

Nothing outside this subpackage imports it.
"""
