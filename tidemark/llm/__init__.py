"""Operators for large training-data pipelines: search, language identification, secret scans,
near and exact deduplication, tokenising, mixing, quality and licence scans.

Nothing outside this package imports it.
"""
