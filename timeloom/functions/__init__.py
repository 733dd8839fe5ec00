"""Column expressions and literals."""
