"""Operators for preparing training text: filters, deduplication, tokens, scoring, sharding."""
