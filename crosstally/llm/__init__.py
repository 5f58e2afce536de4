"""Operators for preparing training data: selection, cleaning, deduplication, tokens, archives."""
