"""Scalar functions: checksums, patterns, masks of single values."""
