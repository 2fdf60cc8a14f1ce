"""Training-data operators: scoring, deduplication, classification, archives, mixing, tokens.

Nothing outside this subpackage imports it.
"""
