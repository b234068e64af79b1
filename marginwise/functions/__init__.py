"""Column expressions and kernel definitions."""
