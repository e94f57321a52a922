"""Column expressions and aggregates over trades."""
