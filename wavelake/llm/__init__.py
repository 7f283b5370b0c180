"""Training-data operators: deduplication, extraction, scoring, mixing, encoding and scanning.

Nothing outside this subpackage imports it.
"""
