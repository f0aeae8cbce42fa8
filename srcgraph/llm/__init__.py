"""Operators for building training data: extraction, scans, duplicates, mixing, packing."""
