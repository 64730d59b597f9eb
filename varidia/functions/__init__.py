"""Column expressions and constant tables."""
