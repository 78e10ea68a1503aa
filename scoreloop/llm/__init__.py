"""Operators for preparing training data: dedup, filters, scoring, packing, token files."""
