"""Training-data operators: deduplication, quality, filtering, tokens, mixing.

Nothing outside this subpackage imports it.
"""
