"""Readers that give page DataFrames, and writers for results."""
