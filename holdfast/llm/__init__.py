"""Training-data operators: dedup, text extraction, tokens, quality, mixing, packing, sharding.

Nothing else in the library imports this subpackage.
"""
