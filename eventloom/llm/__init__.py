"""Operators for preparing training data: dedup, scans, tokens, packing, search, scoring."""
