"""Keyed state over event streams and batches."""
