"""Operators for preparing training text: mixing, tokens, filters, duplicates, personal data."""
