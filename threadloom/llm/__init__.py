"""Operators for training data: exact distinct counts, percentiles, packing, leakage and sentences."""
