"""Operators that a training-data pipeline needs: scans, filters, tokenizers, deduplication.

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
