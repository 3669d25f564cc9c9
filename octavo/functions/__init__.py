"""Column expressions and Arrow kernels for single pages."""
