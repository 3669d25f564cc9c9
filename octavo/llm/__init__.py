"""Operators for cleaning and packing training corpora."""
