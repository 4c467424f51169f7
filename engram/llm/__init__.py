"""Training-data operators: archives, token counts, quality, dedup, packing, PII.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
