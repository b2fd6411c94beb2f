"""Column expressions and small numerical helpers."""
