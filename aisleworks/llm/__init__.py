"""Operators for building language-model training data: filters, deduplication, search, archives, mixing, packing."""
