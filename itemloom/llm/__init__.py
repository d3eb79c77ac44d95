"""Operators for large training-corpus pipelines; nothing outside this subpackage imports it."""
