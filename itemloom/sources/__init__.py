"""Readers of trees, page blocks, price tables and file fingerprints."""
