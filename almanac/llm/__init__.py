"""Operators for preparing training data: packing, scoring, filtering, personal data, search, tokenizing, duplicates."""
