"""Column expressions: nothing here moves data."""
