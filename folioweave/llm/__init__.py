"""Operators for large text collections: term statistics, patterns, tokens, packing, personal data."""
