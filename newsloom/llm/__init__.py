"""Operators for preparing training text: fingerprints, counts, filters, de-duplication, packing and placement."""
