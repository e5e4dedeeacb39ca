"""Operators for preparing training text: packing, deduplication, filters, search, mixing, extraction."""
