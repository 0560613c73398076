"""Operators for large-scale training-data preparation. Nothing outside this subpackage imports it."""
