"""Training-data operators: sharding, scans, scoring, packing, search, deduplication and extraction.

Nothing outside this package imports it.
"""
