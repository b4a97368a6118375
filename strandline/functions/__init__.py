"""Column expressions: text, units, classes."""
