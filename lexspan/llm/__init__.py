"""Operators of a training-data pipeline: sharding, de-duplication, scoring, scans, tokens.

Nothing outside this package imports it. Each module holds one operator with a general
interface; ``queries`` holds the thin queries that derive the registered results.
"""
