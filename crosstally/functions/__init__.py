"""Column expressions: every one returns a ``Column`` built from built-in functions."""
