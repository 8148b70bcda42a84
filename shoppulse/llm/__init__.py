"""Operators for preparing training text: deduplication, scoring, tokenising, mixing.

Nothing outside this package imports it; the queries are in :mod:`.queries`.
"""
